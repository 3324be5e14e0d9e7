"""Exact token counts at every prefix of a text, for byte-level BPE.

For each prefix of a pre-token, dynamic programming finds the one last token its encoding can have: a token
that ends there and may follow the last token of the prefix before it (two tokens may stand side by side
if encoding their bytes together gives the two again). The prefix's count is then one more than that of the
prefix before the token. Counts of a text's prefixes are sums over units: stretches of text that split into
pre-tokens by themselves, whatever stands before or after them (see _units). Units repeat, so a worker remembers
the counts of recent ones, up to a fixed number.

`prefix_counts` stores, for each document, the step in count at each code point. Sums of steps answer "how
many tokens do the first n characters have" and "how many characters fit a budget" without encoding again.

Nulls count as empty text. Special strings are one token each, as the library reads them by default.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, ship, text_of

_REMEMBERED = 200_000  # units in each of two generations
_LONGEST = 48  # characters of a unit that is remembered
#: Ends of the ranges of Unicode white space.
_SPACE = [chr(c) for c in (0x09, 0x0D, 0x20, 0x20, 0x85, 0x85, 0xA0, 0xA0, 0x1680, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x202F, 0x205F, 0x205F, 0x3000, 0x3000)]
_BLANK = "".join(chr(c) for i in range(0, len(_SPACE), 2) for c in range(ord(_SPACE[i]), ord(_SPACE[i + 1]) + 1))
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"


def _byte_of() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache
def _units() -> re.Pattern:
    r"""Units of a text: a contraction; or a pre-token with the white space before it, where that ends in a space
    (which joins the pre-token) or not (and then ends a run that is split before its last character).
    """
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        numeric = c <= sys.maxunicode and unicodedata.category(chr(c)) in ("Nl", "No")
        if numeric and start is None:
            start = c
        elif not numeric and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    other_numbers = "".join(ranges)
    space = "".join(_SPACE[i] + "-" + _SPACE[i + 1] for i in range(0, len(_SPACE), 2))
    not_blank = "[" + _BLANK.replace(" ", "") + "]"
    core = rf"(?:[^\W\d_{other_numbers}]+|[\d{other_numbers}]+|(?:[^\w{space}]|_)+)"
    plain = " ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?!\\w)"  # the usual case, for speed
    return re.compile(rf"{plain}|{_CONTRACTION}|(?:[{space}]* )?{core}|[{space}]*{not_blank}(?:{_CONTRACTION}|{core})?|[{space}]+")


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        byte = _byte_of()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in given["added_tokens"]]
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pairs = [p if isinstance(p, list) else p.split(" ") for p in given["model"]["merges"]]
        words = {raw(t): i for t, i in given["model"]["vocab"].items() if t not in self.special}
        merged = [(words[raw(x)], words[raw(y)], words[raw(x) + raw(y)]) for x, y in pairs]
        self.rank = {x << 32 | y: i for i, (x, y, _) in enumerate(merged)}
        self.made = {t: (x, y, i) for i, (x, y, t) in reversed(list(enumerate(merged)))}
        #: Tokens by their bytes; -1 for bytes that only begin tokens.
        self.tokens = {t[:n]: -1 for t in words for n in range(1, len(t))} | words
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.beside: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """The tokens that stand at this edge while the token is made, each with the rank of the merge that takes it in."""
        found = known.get(token)
        if found is None:
            found, t, until = [], token, 1 << 60
            while True:
                found.append((t, until))
                if t not in self.made:
                    break
                until = self.made[t][2]
                t = self.made[t][side]
            known[token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether bytes of a and b, encoded together, give a and b: no merge across comes before both sides are made.

        Of merges of one rank the leftmost comes first.
        """
        if len(self.beside) > 2 * _REMEMBERED:
            self.beside.clear()
        rank, never, starts = self.rank, 1 << 61, self._edge(b, 0, self.left)
        fits = True
        for x, until_x in self._edge(a, 1, self.right):
            for y, until_y in starts:
                r = rank.get(x << 32 | y, never)
                if r < until_x and r <= until_y:
                    fits = False
        self.beside[a << 32 | b] = fits
        return fits

    def prefixes(self, piece: str) -> list[int]:
        """Token counts of the piece's prefixes of 1, 2, ... characters, the piece taken as one pre-token."""
        data = piece.encode()
        n = len(data)
        tokens, beside = self.tokens, self.beside
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, more = last[start], count[start] + 1
            for end in range(start + 1, n + 1):
                token = tokens.get(data[start:end])
                if token is None:
                    break
                if token < 0 or last[end] >= 0:
                    continue
                if start:
                    fits = beside.get(before << 32 | token)
                    if fits is None:
                        fits = self.may_follow(before, token)
                    if not fits:
                        continue
                last[end], count[end] = token, more
        if n == len(piece):
            return count[1:]
        return [c for c, b in zip(count[1:], [*data[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def steps(self, unit: str) -> bytes:
        """What each character of the unit adds to the count, as int16."""
        core = unit.lstrip(_BLANK)
        space = unit[: len(unit) - len(core)]
        if core and (not space or space == " "):
            counts = self.prefixes(unit)
            if not space and unit in _LONG_CONTRACTIONS:
                counts[1] = self.prefixes("'")[0] + self.prefixes(core[1])[0]
            return self._steps(counts)
        counts = self.prefixes(space)
        if core:
            if space[-1] == " ":
                head, body = counts[-2], " " + core
            else:
                head, body = (counts[-2] if len(space) > 1 else 0) + self.prefixes(space[-1])[-1], core
            inner = self.prefixes(body)
            if body in _LONG_CONTRACTIONS:
                inner[1] = self.prefixes("'")[0] + self.prefixes(core[1])[0]
            if space[-1] == " ":
                inner = inner[1:]
            counts = [*counts, *(head + n for n in inner)]
        return self._steps(counts)

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return array("h", [b - a for a, b in zip([0, *counts], counts, strict=False)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.old.get(unit) or self.steps(unit)
        if len(unit) <= _LONGEST:
            if len(self.new) >= _REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[unit] = found
        return found

    def _ordinary(self, text: str) -> np.ndarray:
        new, miss = self.new.get, self._unit
        out = []
        for u in _units().findall(text):
            out.append(new(u) or miss(u))
            if self.new.get is not new:
                new = self.new.get
        return np.frombuffer(b"".join(out), dtype=np.int16)

    def __call__(self, text: str) -> np.ndarray:
        """The step in count at each character; the sum is the text's token count."""
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        parts, at = [], 0
        for m in self.split.finditer(text):
            # up to its last character, the special string is ordinary text
            inside = self._ordinary(text[at : m.end() - 1])
            whole = int(self._ordinary(text[at : m.start()]).sum()) + 1
            parts += [inside, np.array([whole - int(inside.sum())], dtype=np.int16)]
            at = m.end()
        return np.concatenate([*parts, self._ordinary(text[at:])])


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokens_in(steps: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(steps, dtype=np.int16)[:n_chars].sum(dtype=np.int64))


def fits(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(steps, dtype=np.int16), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(spark: SparkSession, df: DataFrame, tokenizer: str, store: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, with `store`, the steps at every prefix (int16, little endian). No shuffle."""
    import pyarrow as pa

    ship(spark)
    rows = columns_only(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    names = ["doc_id", "n_bytes", "n_tokens", *(["steps"] if store else [])]

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                steps = [count(t) for t in part[2].to_pylist()]
                out = [part[0], part[1], pa.array([int(s.sum(dtype=np.int64)) for s in steps], type=pa.int64())]
                if store:
                    out.append(pa.array([s.tobytes() for s in steps], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long" + ", steps binary" * store)
