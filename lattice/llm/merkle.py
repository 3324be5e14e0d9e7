"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

A text is cut, without losing a character, into sections (ended by a blank line), paragraphs (lines) and
clauses (ended by punctuation, or after four words; long runs of one kind are cut). A clause's leaf is a short
hash and its length; a paragraph's digest covers its clauses, a section's its paragraphs and the root's
its sections, with a prefix for each level. Equal roots mean equal texts; where roots differ, only
branches with unequal digests need a look to find the edit, and to tell how alike the texts are.

Nulls count as empty text. An empty text has a root and no sections. Extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, rows_out, ship, text_of, width

_CLAUSE = re.compile(r"(?:[^\s.!?,;:|]{1,24}[^\S\n]{0,15}){1,4}(?:[.!?,;:|]{1,40}[^\S\n]{0,15})?\n?|[.!?,;:|]{1,40}[^\S\n]{0,15}\n?|[^\S\n]{1,200}\n?|\n")  # 255 characters at most
_LEAF = 10  # hex digits of a leaf: 8 of its hash, 2 of its length
_MEMO = 200_000  # clauses remembered by a task


def _digest(level: bytes, parts: Iterable[str], size: int) -> str:
    return hashlib.blake2b("".join(parts).encode(), digest_size=size, person=level).hexdigest()


class Fingerprinter:
    """Builds fingerprints; remembers the leaves of recent clauses, up to a fixed number."""

    def __init__(self) -> None:
        self.memo: dict[str, str] = {}

    def leaf(self, clause: str) -> str:
        """32 hex digits of the clause's hash and 2 of its length."""
        leaf = self.memo.get(clause)
        if leaf is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            leaf = self.memo[clause] = hashlib.blake2b(clause.encode(), digest_size=16).hexdigest() + f"{len(clause):02x}"
        return leaf

    def __call__(self, text: str) -> str:
        """root length ';' section ';' ..., a section being digest ':' paragraph ',' ..., a paragraph digest and leaves.

        Digests are computed from whole digests of the level below and written at a shorter length.
        """
        sections, paragraphs, leaves = [], [], []  # (whole digest, what is written)

        def close_paragraph() -> None:
            if leaves:
                d = _digest(b"paragraph", leaves, 16)
                paragraphs.append((d, d[:16] + "".join([x[:8] + x[32:] for x in leaves])))
                leaves.clear()

        def close_section() -> None:
            if paragraphs:
                d = _digest(b"section", (p[0] for p in paragraphs), 16)
                sections.append((d, d[:16] + ":" + ",".join([p[1] for p in paragraphs])))
                paragraphs.clear()

        for clause in _CLAUSE.findall(text):
            leaves.append(self.leaf(clause))
            if clause[-1] == "\n":
                blank = clause == "\n" and len(leaves) == 1
                close_paragraph()
                if blank:
                    close_section()
        close_paragraph()
        close_section()
        return _digest(b"root", [str(len(text)), *("/" + s[0] for s in sections)], 16) + f"{len(text):x}" + "".join([";" + s[1] for s in sections])


def root(fingerprint: str) -> str:
    return fingerprint[:32]


@dataclass
class Tree:
    """A fingerprint taken apart: root, length of the text, and sections of (digest, paragraphs)."""

    root: str
    n_chars: int
    sections: list[tuple[str, list[str]]]

    @classmethod
    def of(cls, fingerprint: str) -> Tree:
        head, *sections = fingerprint.split(";")
        return cls(head[:32], int(head[32:], 16), [(s[:16], s[17:].split(",")) for s in sections])


def _unmatched(a: Iterable, b: Iterable, digest: Callable) -> tuple[list, list]:
    """The branches of each side that have no partner of equal digest on the other, each branch used once."""
    left, right = list(a), []
    count = Counter(map(digest, left))
    for x in b:
        if count.get(d := digest(x), 0):
            count[d] -= 1
        else:
            right.append(x)
    out = []
    for x in reversed(left):  # what is left of each digest are its last branches
        if count.get(d := digest(x), 0):
            count[d] -= 1
            out.append(x)
    return out[::-1], right


def _differing(a: Tree, b: Tree) -> tuple[list[str], list[str]]:
    """Paragraphs in unequal sections that are unequal themselves."""
    x, y = _unmatched(a.sections, b.sections, itemgetter(0))
    return _unmatched((p for s in x for p in s[1]), (p for s in y for p in s[1]), itemgetter(slice(16)))


def _leaves(paragraphs: list[str]) -> Counter:
    return Counter([p[i : i + _LEAF] for p in paragraphs for i in range(16, len(p), _LEAF)])


def likeness(a: Tree, b: Tree) -> float:
    """Share of the two texts' characters that both have, by equal sections, then paragraphs, then clauses of what differs; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    total = a.n_chars + b.n_chars
    if not total:
        return 0.0
    x, y = map(_leaves, _differing(a, b))
    apart = sum(abs(n - y.get(k, 0)) * int(k[8:], 16) for k, n in x.items()) + sum(n * int(k[8:], 16) for k, n in y.items() if k not in x)
    return (total - apart) / total


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of b that a does not have in a section of equal digest or as an equal paragraph."""
    x, y = Tree.of(a), Tree.of(b)
    if x.root == y.root:
        return []
    named = [(d, [(i, j, p) for j, p in enumerate(paragraphs)]) for i, (d, paragraphs) in enumerate(y.sections)]
    left, right = _unmatched(x.sections, named, itemgetter(0))
    _, found = _unmatched([(0, 0, p) for s in left for p in s[1]], [p for s in right for p in s[1]], lambda p: p[2][:16])
    return [(i, j) for i, j, _ in found]


def fingerprints(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, fingerprint. Nothing is shuffled."""
    import pyarrow as pa

    ship(spark)
    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        make = Fingerprinter()
        for b in batches:
            yield from rows_out(schema, [(i, len(t), make(t)) for i, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)])

    rows = df.select(F.col(id_col).cast("long"), text_of(text_col))
    return rows.mapInArrow(run, f"`{id_col}` long, n_chars long, fingerprint string")


def _bucket(place: Column, bounds: list) -> Column:
    """How many of the ascending bounds are not above the place: a search among every m-th of them, then among m."""
    if not bounds:
        return F.lit(0)
    m = math.isqrt(len(bounds)) + 1
    count = lambda a: F.size(F.filter(a, lambda x: x <= place))
    coarse = count(F.lit(bounds[::m]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * m + count(F.slice(F.lit(bounds), (coarse - 1) * m + 1, F.lit(m))))


def _with_successor(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, borrowed, place, doc_id, text): each bucket a range of places, followed by its successor's first row.

    A row's place is its id, then 32 bits of a hash of its text, so that rows of one id are dealt out too. Bucket bounds are
    quantiles of the places, and the first place of each bucket is collected: a few numbers a shuffle partition, whatever the
    input. Texts are shuffled once. Rows without an id come last.
    """
    n = 4 * width(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)")
    place = (key + F.pmod(F.xxhash64("text"), F.lit(2**32))).cast("decimal(38,0)")
    places = docs.select(place.alias("place"))
    bounds = places.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    at = _bucket(F.col("place"), sorted(set(bounds)))
    firsts = sorted((r[0], r[1]) for r in places.withColumn("bucket", at).groupBy("bucket").agg(F.min("place")).collect())
    lent = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first bucket's first row goes to the last
    lent = spark.createDataFrame(lent, "first decimal(38,0), to int")
    rows = docs.select(place.alias("place"), "doc_id", "text").withColumn("bucket", at)
    rows = rows.join(F.broadcast(lent), F.col("place") == F.col("first"), "left")  # a row a bucket
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("borrowed"))
    borrowed = F.struct(F.col("to").alias("bucket"), F.lit(1).alias("borrowed"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, borrowed))))
    return rows.select("p.bucket", "p.borrowed", "place", "doc_id", "text"), n


def edit_fingerprints(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its text with the last quarter replaced from the next one, and likenesses.

    Rows with equal ids are ordered by a hash of their text, then by text. The next of the last document is the first.
    """
    import pyarrow as pa

    ship(spark)
    docs = columns_only(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows, n = _with_successor(spark, docs)
    order = ["bucket", "borrowed", "place", "text"]
    dealt = rows.repartition(n // 4, "bucket").sortWithinPartitions(*order).select("bucket", "borrowed", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches) -> Iterator[tuple[int | None, str, str]]:
        last = None
        for b in batches:
            for bucket, borrowed, doc, text in zip(*(b[i].to_pylist() for i in range(4)), strict=True):
                if last and last[0] == bucket and not last[1]:
                    yield last[2], last[3], text
                last = bucket, borrowed, doc, text

    def run(batches):
        make, out, size = Fingerprinter(), [], 0
        known, known_print, known_tree = None, "", None
        for doc, text, after in pairs(batches):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut] if cut else text
            if text != known:
                known_print = make(text)
                known_tree = Tree.of(known_print)
            mine, tree = known_print, known_tree
            other = mine if edited == text else make(edited)
            near = 1.0 if other == mine else likeness(tree, Tree.of(other))
            known, known_print = after, make(after)
            known_tree = Tree.of(known_print)
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, other, near, likeness(tree, known_tree)))
            size += len(text)
            if size > 4_000_000:
                yield from rows_out(schema, out)
                out, size = [], 0
        yield from rows_out(schema, out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
