"""Pages as sequences of leaf blocks: text with its path of open elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# HTML elements by how they are read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style head template textarea".split())
#: Elements nested deeper than this are read as if they stood at this depth, as browsers do.
DEPTH = 512
#: Part of a page's text that makes an element a wrapper of the page, and that of one without the page's heading or article.
WRAPS, WRAPS_ALL = 0.8, 0.95
#: Wrappers inside each other.
WRAPPERS = 16
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in SKIPPED_TAGS}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # elements from the root, each "tag name name"
    links: int = 0  # characters inside links


@dataclass
class _Reader:
    stack: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    beyond: Counter = field(default_factory=Counter)  # open elements below the greatest depth
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    path: tuple[str, ...] | None = None
    here: tuple[str, ...] | None = ()  # the path of the open elements, once asked for

    def text(self, raw: str) -> None:
        if raw:
            if self.path is None and not raw.isspace():
                if self.here is None:
                    self.here = tuple(self.keys)
                self.path = self.here
            self.pieces.append(raw)
            if self.open["a"] or self.beyond["a"]:
                self.links += len(raw)

    def flush(self) -> None:
        if self.path is not None:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append(Block(text, self.path, self.links))
        self.pieces, self.links, self.path = [], 0, None

    def push(self, tag: str, key: str) -> None:
        if len(self.stack) >= DEPTH:
            self.beyond[tag] += 1
            return
        self.stack.append(tag)
        self.keys.append(key)
        self.open[tag] += 1
        self.here = None

    def cut(self, at: int) -> None:
        self.open.subtract(self.stack[at:])
        del self.stack[at:], self.keys[at:]
        self.here = None

    def close(self, tag: str) -> None:
        if self.beyond[tag]:
            self.beyond[tag] -= 1
        elif self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at] != tag:
                at -= 1
            self.cut(at)

    def imply(self, tag: str) -> None:
        """Ends that an opening tag implies: of a paragraph before any block, of a list item before the next."""
        if tag in BLOCK_TAGS and (self.open["p"] or self.beyond["p"]):
            self.close("p")
        if tag not in _SCOPES or not any(self.open[t] for t in _CLOSES[tag]):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in _SCOPES[tag]:
                break
            if self.stack[k] in _CLOSES[tag]:
                self.cut(k)
                break


def _key(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = " ".join(m[1].strip("\"'") for m in _NAMES.finditer(attributes))
    return f"{tag} {names.lower()}" if names else tag


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; white space inside a block is one blank, character references are decoded.

    Elements that hold the page as a whole lose their names (see ``unwrapped``). The page is read once from front to back, in
    time that grows with its length, also where tags, quotes, comments or elements are never closed.
    """
    page, reader, at, unclosed = page or "", _Reader(), 0, set()
    last = page.rfind(">") + 1  # no tag ends behind this
    while True:
        m = _TAG.search(page, at, last) if at < last else None
        if m is None:
            reader.text(page[at:].partition("<!--")[0])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            break
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            reader.flush()
        elif tag == "br":
            reader.pieces.append(" ")
        if closing:
            reader.close(tag)
        elif tag in SKIPPED_TAGS and not attributes.endswith("/"):
            end = None if tag in unclosed else _ENDS[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea"):  # what follows is theirs
                break
            else:
                unclosed.add(tag)
        elif tag not in VOID_TAGS and not (attributes.endswith("/") and tag not in BLOCK_TAGS):
            reader.imply(tag)
            reader.push(tag, _key(tag, attributes))
    reader.flush()
    return unwrapped(reader.blocks)


def _heads(path: tuple[str, ...]) -> bool:
    return any(e.startswith(("h1", "article", "main")) for e in path)


def unwrapped(found: list[Block]) -> list[Block]:
    """The blocks with bare elements in place of those that hold most of the page: a class of the body, or of a container
    around everything, says how the page is laid out, not which part of it a block is. A form around the page is a container."""
    total, headed = sum(len(b.text) for b in found), any(_heads(b.path) for b in found)
    inside, bare = found, []
    while len(bare) < WRAPPERS:
        depth, size = len(bare), Counter()
        for b in inside:
            if len(b.path) > depth:
                size[b.path[depth]] += len(b.text)
        if not size:
            break
        key, most = size.most_common(1)[0]
        within = [b for b in inside if len(b.path) > depth and b.path[depth] == key]
        tag = key.partition(" ")[0]
        if most < WRAPS * total or tag in ("article", "main"):
            break
        if not any(_heads(b.path[depth + 1 :]) for b in within) if headed else most < WRAPS_ALL * total:
            break
        bare.append("div" if tag == "form" else tag)
        inside = within
    if not bare:
        return found
    known: dict[int, tuple[str, ...]] = {}  # blocks of one place share their path
    wrapped = tuple(inside[0].path[: len(bare)])

    def shown(path: tuple[str, ...]) -> tuple[str, ...]:
        if id(path) not in known:
            k = 0
            while k < min(len(path), len(bare)) and path[k] == wrapped[k]:
                k += 1
            known[id(path)] = (*bare[:k], *path[k:])
        return known[id(path)]

    return [Block(b.text, shown(b.path), b.links) for b in found]
