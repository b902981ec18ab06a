"""Figures of a text that the quality operators share."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "word_length",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "distinct_share",
    "bang_share",
    "bar_share",
    "digit_share",
    "line_words",
    "stop_share",
    "longest_run_share",
)


def _count(text: bytes, those: bytes) -> int:
    return len(text) - len(text.translate(None, those))


def repeated_words(codes: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words inside windows of three words that occur twice or more, the first included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    a, b, c = codes[:n], codes[1 : n + 1], codes[2 : n + 2]
    if distinct < 1 << 20:
        keys = (a * distinct + b) * distinct + c
    else:
        pairs = np.unique(a * distinct + b, return_inverse=True)[1]
        keys = pairs * distinct + c
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Counts named in ``BASE`` and shares named in ``FEATURES``; a null text counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text) - _count(text, _CONTINUED) - _count(text, _SPACE)
    symbols = _count(text, SYMBOLS)
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    if not n:
        return (0, chars, symbols, 0, 0), (0.0,) * len(FEATURES)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(codes, len(number))
    upper, lower = _count(text, _UPPER), _count(text, _LOWER)
    steps = np.flatnonzero(np.diff(codes))
    longest = int(np.diff(np.concatenate([[-1], steps, [n - 1]])).max())
    features = (
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        dup / lines,
        repeats / n,
        upper / max(1, upper + lower),
        len(number) / n,
        text.count(b"!") / n,
        text.count(b"|") / n,
        _count(text, _DIGITS) / chars,
        n / lines,
        sum(text.count(x) for x in (b".", b"?", b";")) / n,
        longest / n,
    )
    return (n, chars, symbols, dup, repeats), features
