"""Plain versions of the pipeline's decisions, for small tables."""

import re

from tidemark.llm.simhash import fingerprint


def _languages(rows, items):
    return {r.doc_id: r.text for r in rows if any(c.isalpha() for c in r.text or "")}


def _near(rows, items):
    prints = {r.doc_id: fingerprint((r.text or "").encode()) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {r.doc_id: r.text for r in rows if find(r.doc_id) == r.doc_id}


def _windows(rows, items):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        words = (r.text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if seen.setdefault(tuple(words[k : k + 20]), (r.doc_id, k)) != (r.doc_id, k):
                gone[k : k + 20] = [True] * 20
        if any(gone):
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text)]
            text = r.text
            for k in reversed(range(len(words))):  # words go from behind, each with the blanks after it
                if gone[k]:
                    text = text[: places[k][0]] + (text[places[k + 1][0] :] if k + 1 < len(words) else "")
                    places[k + 1 :] = [(a - places[k + 1][0] + places[k][0], b) for a, b in places[k + 1 :]]
            if not all(gone):
                out[r.doc_id] = text.rstrip(" \t\n\r\x0b\x0c") if gone[-1] else text
        else:
            out[r.doc_id] = r.text
    return out


def _leaks(rows, items):
    """Verbatim runs of 13 words or more than half of an item."""
    squeezed = lambda t: re.findall(r"\w+", (t or "").lower())
    runs = set()
    for item in items:
        words = squeezed(item.text)
        need = min(13, len(words) // 2 + 1)
        runs |= {tuple(words[k : k + need]) for k in range(len(words) - need + 1)}
    out = {}
    for r in rows:
        words = squeezed(r.text)
        if not any(tuple(words[k : k + n]) in runs for n in {len(x) for x in runs} for k in range(len(words) - n + 1)):
            out[r.doc_id] = r.text
    return out


def kept_by_brute_force(number, rows, items):
    return (None, _languages, _near, _windows, _leaks)[number](rows, items)
