"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags. Each has features of its ancestors (tags, words of
class, id and role) and of its text (length, share of links, punctuation, words of short blocks). A chain
over the blocks in page order is trained on labelled pages by gradient steps on the conditional likelihood, and decoded by
Viterbi. The text is the blocks labelled main, character references decoded, white space inside a block made one space,
joined by line feeds.

What is never text: comments, scripts, styles, heads, templates and the like. Null html is empty. What is not closed (a comment,
a tag, a quoted value, a script) runs to the end of the page; crossed tags are handled as browsers do in the common
cases. Every step is a search that ends where the next begins or a look at the innermost open elements, so that parsing is
linear in the page's length, whatever is in it.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, rows_out, ship, text_of

TRAINING_PAGES = 700  # the bound of the labelled sample

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style title head noscript template iframe svg object canvas audio video".split())
_RAW = frozenset("script style title noscript iframe textarea".split())
_PHRASING = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label map mark math object output q ruby rp rt s samp small span strike strong sub sup svg time tt u var html".split())
_TAGS = _BLOCK | _VOID | _UNSEEN | _RAW | _PHRASING
#: Tags that an opening tag closes, as far as one of the last set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_CLOSE_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _RAW}


@dataclass
class Block:
    text: str
    features: set[str]
    main: bool = False
    links: float = 0.0


@dataclass
class _Frame:
    tag: str
    names: frozenset[str]  # features of this element and those around it
    main: bool
    unseen: bool
    link: bool
    block: str  # the innermost block-level tag, of this element or around it
    blocks: int  # how many block-level elements this is in, itself included


_NO_FRAME = _Frame("", frozenset(), False, False, False, "", 0)


class _Open:
    """The open elements, and for each tag where it is open."""

    def __init__(self) -> None:
        self.stack: list[_Frame] = []
        self.at: dict[str, list[int]] = {}

    @property
    def top(self) -> _Frame:
        return self.stack[-1] if self.stack else _NO_FRAME

    def push(self, frame: _Frame) -> None:
        self.at.setdefault(frame.tag, []).append(len(self.stack))
        self.stack.append(frame)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """The depth of the innermost element with one of the tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def block_within(self, depth: int) -> bool:
        """Whether a block-level element is open inside the element at this depth."""
        return self.top.blocks > self.stack[depth].blocks


def _names(tag: str, attributes: str) -> tuple[frozenset[str], bool]:
    """The features of an element's tag and names, and whether it is labelled main."""
    return _short_names(tag, attributes) if len(attributes) <= 500 else _all_names(tag, attributes)


def _all_names(tag: str, attributes: str) -> tuple[frozenset[str], bool]:
    found, main = {f"in:{tag if tag in _TAGS else 'other'}"}, False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-main":
            main = value == "1"
        else:
            found |= {f"name:{w.lower()}" for w in _PART.findall(value)}
    return frozenset(found), main


_short_names = functools.lru_cache(maxsize=4096)(_all_names)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order, without page-wide features. Of ancestors' features, those that are known, if that is given."""
    out: list[Block] = []
    open_ = _Open()
    pieces: list[tuple[str, bool]] = []
    holder: list[_Frame] = [_NO_FRAME]

    def flush() -> None:
        if not pieces:
            return
        raw = "".join(p for p, _ in pieces)
        text = _SPACE.sub(" ", entities.unescape(raw)).strip()
        if text:
            top = holder[0]
            linked = sum(len(p) for p, link in pieces if link) / max(1, len(raw))
            out.append(Block(text, {*top.names, f"own:{open_.top.block}"}, top.main, linked))
        pieces.clear()

    def add(text: str) -> None:
        top = open_.top
        if text and not top.unseen:
            if not pieces:
                holder[0] = top
                if not text.strip():
                    return
            pieces.append((text, top.link))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if closing:
            depth = -1 if tag in _VOID else open_.last(tag)
            if depth >= 0:
                if tag in _BLOCK or not open_.block_within(depth):
                    if tag in _BLOCK:
                        flush()
                    open_.pop_to(depth)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            depth = open_.last("p")
            if depth >= 0 and tag not in ("option", "select", "button", "textarea", "optgroup", "legend") and not open_.block_within(depth):
                open_.pop_to(depth)
        if tag in _CLOSES:
            close, stop = _CLOSES[tag]
            depth = open_.last(*close)
            if depth > open_.last(*stop):
                flush()
                open_.pop_to(depth)
        if tag == "br":
            add(" ")
        if tag in _VOID or m[3].endswith("/") and tag in ("path", "g", "use"):
            continue
        names, main = _names(tag, m[3])
        top = open_.top
        names = top.names | names if known is None else top.names | names & known
        is_block = tag in _BLOCK
        open_.push(_Frame(tag, names, main or top.main and not is_block, top.unseen or tag in _UNSEEN, top.link or tag == "a", tag if is_block else top.block, top.blocks + is_block))
        if tag in _RAW:
            close_at = _CLOSE_RAW[tag].search(page, at)
            if tag == "textarea":
                add(page[at : close_at.start() if close_at else end])
                flush()
            open_.pop_to(len(open_.stack) - 1)
            at = close_at.end() if close_at else end
    flush()
    return out


def featured(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks with all their features; core elements are known in any case."""
    found = blocks(page, known)
    core = {"in:article", "in:main"}
    has_core = any(core & b.features for b in found)
    n = len(found)
    for i, b in enumerate(found):
        f, t = b.features, b.text
        words = t.split(" ", 40)
        f.add(f"chars:{min(10, int(math.log2(len(t) + 1)))}")
        f.add(f"links:{0 if b.links == 0 else 1 if b.links < 0.3 else 2 if b.links < 0.8 else 3}")
        f.add(f"end:{t[-1] if t[-1] in '.!?:;' else 'w'}")
        f.add(f"commas:{min(3, t.count(','))}")
        if has_core:
            f.add("core:in" if core & f else "core:out")
        f.add(f"from_start:{min(i, 3)}")
        f.add(f"from_end:{min(n - 1 - i, 3)}")
        if core & f:  # inside an article, any wording may be the article's
            continue
        if "©" in t:
            f.add("sign:copyright")
        if len(words) <= 12:
            f.update(f"word:{w.strip('.,:!').lower()}" for w in words)
    return found


class ChainCRF:
    """Two labels (0: around the article, 1: main). Scores: a weight a feature for label 1, transitions, starts and ends."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.index, self.weights, self.transitions, self.start, self.stop = index, weights, transitions, start, stop
        self.seen = frozenset(index) | {"in:article", "in:main"}

    def emissions(self, found: list[Block]) -> list[float]:
        index, weights = self.index, self.weights
        return [float(sum(weights[i] for i in map(index.get, b.features) if i is not None)) for b in found]

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not emissions:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + emissions[0]
        back = []
        for e in emissions[1:]:
            a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((0 if a0 >= a1 else 1, 0 if b0 > b1 else 1))
            a, b = max(a0, a1), max(b0, b1) + e
        label = 0 if a + float(self.stop[0]) > b + float(self.stop[1]) else 1
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> str:
        found = featured(page, self.seen)
        return "\n".join(b.text for b, main in zip(found, self.decode(self.emissions(found)), strict=True) if main)

    @classmethod
    def fit(cls, pages: list[list[Block]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seen: int = 3) -> ChainCRF:
        """Adagrad on the negative conditional log-likelihood, page by page in a fixed order."""
        counts: dict[str, int] = {}
        for p in pages:
            for b in p:
                for f in b.features:
                    counts[f] = counts.get(f, 0) + 1
        index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= seen))}
        data = [([np.array(sorted(index[f] for f in b.features if f in index), np.int64) for b in p], np.array([int(b.main) for b in p])) for p in pages if p]
        w, gw = np.zeros(len(index)), np.full(len(index), 1e-6)
        chain, gchain = np.zeros(8), np.full(8, 1e-6)  # transitions 0-3, start 4-5, stop 6-7
        rng = np.random.default_rng(1)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                rows, y = data[k]
                n = len(rows)
                e = np.zeros((n, 2))
                e[:, 1] = [w[r].sum() for r in rows]
                t = chain[:4].reshape(2, 2)
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = chain[4:6] + e[0]
                for i in range(1, n):
                    fwd[i] = np.logaddexp(fwd[i - 1, 0] + t[0], fwd[i - 1, 1] + t[1]) + e[i]
                bwd[-1] = chain[6:8]
                for i in range(n - 2, -1, -1):
                    nxt = bwd[i + 1] + e[i + 1]
                    bwd[i] = np.logaddexp(t[:, 0] + nxt[0], t[:, 1] + nxt[1])
                z = np.logaddexp(*(fwd[-1] + bwd[-1]))
                p = np.exp(fwd + bwd - z)
                g = np.zeros(8)
                if n > 1:
                    pair = np.exp(fwd[:-1, :, None] + t[None] + (e[1:] + bwd[1:])[:, None, :] - z).sum(axis=0)
                    g[:4] = pair.ravel()
                    np.subtract.at(g, 2 * y[:-1] + y[1:], 1)
                g[4:6] += p[0]
                g[6:8] += p[-1]
                g[4 + y[0]] -= 1
                g[6 + y[-1]] -= 1
                gchain += g * g
                chain -= rate * g / np.sqrt(gchain)
                flat = np.concatenate(rows)
                step = np.repeat(p[:, 1] - y, [len(r) for r in rows])
                used, at = np.unique(flat, return_inverse=True)
                d = np.bincount(at, step) + decay * w[used]
                gw[used] += d * d
                w[used] -= rate * d / np.sqrt(gw[used])
        return cls(index, w, chain[:4].reshape(2, 2), chain[4:6], chain[6:8])


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> ChainCRF:
    """The model fitted on the labelled pages; the same on every run."""
    from lattice.llm.labelled_pages import labelled_pages

    return ChainCRF.fit([featured(p) for p in labelled_pages(pages, seed)])


def extract(spark: SparkSession, pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row a page; nothing is shuffled."""
    import pyarrow as pa

    ship(spark)
    shared = spark.sparkContext.broadcast(model or trained())  # a few thousand weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        crf = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [crf.extract(h) for h in part[2].to_pylist()]
                yield from rows_out(schema, list(zip(part[0].to_pylist(), part[1].to_pylist(), texts, map(len, texts), strict=True)))

    rows = columns_only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", text_of("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
