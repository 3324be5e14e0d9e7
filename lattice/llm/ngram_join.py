"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two documents link when the Jaccard similarity of their sets of word shingles reaches the threshold. Equal sets are one class,
represented by a 64-bit signature; the join is between classes, exact, in these steps:

1. Sets (one pass over the texts). Words and shingles are hashed to 64 bits in numpy; each task writes the hashes of its
   distinct sets to ranges of hashes, six bytes each. There are as many ranges as shuffle partitions, more where a
   range would stand for over _RANGE_BYTES of text; each is one partition.
2. Inverted lists. Each range finds how many classes have each hash, some of its hashes at a time (_AT_ONCE). A hash of one class
   can be in no intersection; the others go back to their class, with their frequency. Hashes that are very frequent within
   one task's rows are marked there and go straight to their class, so no range gathers a posting for each of a third of all rows.
3. A class with u hashes of its own and n in all can have partners only if u < n - ceil(t * n) + 1 (the rarest so many of its
   hashes hold one of any partner's). The other classes are the candidates; what they share with anything is
   now in their rows, so no text or set is read again.
4. Size-aware index. Small sets enumerate the 2-subsets of their rarest hashes (two of the rarest n - ceil(t * n) + 2 are a
   partner's too); large sets scan the inverted lists of single hashes, as do small ones that a large set can reach. The boundary
   is the size at which the sum of subsets enumerated and postings scanned is least, from grouped counts by size.
5. Pairs. Within a list, all classes are first compared with one pivot (the class with the smallest share of
   hashes of its own) and the links are contracted; then each class outside its pivot's component is compared with all of other
   components whose sizes, own hashes and hash profiles allow a link. So no link between components is lost, and a large group
   of near copies costs a comparison a copy.
6. Components of the links, and of each document by its class.

Nulls and texts without words have the empty set and are linked with nothing. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, discard, lookup, lookup_wide, scratch, ship, staged, text_of, width
from lattice.llm.graph import components

_SLICE = 1 << 19  # bytes of text whose words are hashed at once
_CHUNK = 1_000_000  # hashes that a task gathers before it writes them
_AT_ONCE = 1 << 20  # hashes of a range that are sorted together
_RANGE_BYTES = 64 << 20
_FREQUENT = 16  # a hash of at least one in so many sets of a chunk (and of 64) is marked as frequent
_PROFILE = 64  # classes of hashes that a profile counts
_PARITY = 8  # longs of the parity of 64 finer classes each
_MARKED = 255
_LOW = np.uint64((1 << 48) - 1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in data, from starts: (hashes, text of each, set sizes, signatures).

    Hashes are distinct and ascending within a text.
    """
    n_texts = len(starts)
    b = data
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    first = ~blank
    inner = np.ones(len(b), bool)
    inner[starts[starts < len(b)]] = False
    first[1:] &= blank[:-1] | ~inner[1:]
    solid = np.flatnonzero(~blank)
    begin = np.flatnonzero(first)
    words = np.zeros(n_texts, np.int64)
    if len(begin):
        at = np.searchsorted(solid, begin)
        lengths = np.diff(at, append=len(solid))
        c = b[solid]
        c = c + ((c >= 65) & (c <= 90)).astype(np.uint8) * np.uint8(32)
        place = np.arange(len(solid)) - np.repeat(at, lengths)
        word = np.add.reduceat(_BYTES[c] * _powers(_M1, int(lengths.max()))[place], at)
        word = _mix(word + lengths.astype(np.uint64) * _M3)
        words = np.diff(np.searchsorted(begin, starts), append=len(begin)) if n_texts else words
    first_word = np.cumsum(words) - words
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(n_texts), count)
    if not len(text):
        zero = np.zeros(n_texts, np.int64)
        return np.zeros(0, np.uint64), text, zero, zero.astype(np.uint64)
    at = first_word[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(text), np.uint64)
    step = _powers(_M2, size + 1)
    for k in range(size):  # texts with fewer words have one shingle of all their words
        there = words[text] > k
        h[there] += word[at[there] + k] * step[k + 1]
    h = _mix(h + np.minimum(words[text], size).astype(np.uint64))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    n = np.bincount(text, minlength=n_texts)
    sums = np.zeros(n_texts, np.uint64)
    full = n > 0
    sums[full] = np.add.reduceat(_mix(h ^ _M1), (np.cumsum(n) - n)[full])
    return h, text, n, _mix(sums + n.astype(np.uint64) * _M1)


# Payloads between tasks: for groups of hashes, their class's signature and size and how many there are, then the hashes.


def _pack(kind: int, sig: np.ndarray, n: np.ndarray, count: np.ndarray, *columns: np.ndarray) -> bytes:
    rows = len(columns[0]) if columns else 0
    return struct.pack("<BII", kind, len(sig), rows) + b"".join(a.tobytes() for a in (sig.astype(np.uint64), n.astype(np.uint32), count.astype(np.uint32), *columns))


def _unpack(payload: bytes, types: tuple) -> tuple:
    _, k, m = struct.unpack_from("<BII", payload)
    at, out = 9, []
    for t, size in ((np.uint64, k), (np.uint32, k), (np.uint32, k), *((t, m) for t in types)):
        out.append(np.frombuffer(payload, t, size, at))
        at += np.dtype(t).itemsize * size
    return tuple(out)


_POSTINGS, _FOUND, _MARKS, _DOCUMENTS = range(4)
_LISTS = {_POSTINGS: (np.uint32, np.uint16), _FOUND: (np.uint32, np.uint16, np.uint32, np.uint8), _MARKS: (np.uint32, np.uint16), _DOCUMENTS: (np.int64, np.uint8)}


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = h & _LOW
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(sig ^ _M2) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


class _Chunk:
    """The sets of some of a task's rows."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.total = 0

    def add(self, ids, nulls, h, n, sig) -> None:
        for to, what in ((self.hashes, h), (self.sizes, n), (self.sigs, sig), (self.ids, ids), (self.nulls, nulls)):
            to.append(what)
        self.total += len(h)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(range, payload)"""
        if not self.ids:
            return
        h, n, sig = np.concatenate(self.hashes), np.concatenate(self.sizes), np.concatenate(self.sigs)
        ids, nulls = np.concatenate(self.ids), np.concatenate(self.nulls)
        where = _bucket_of(sig ^ _mix(ids.astype(np.uint64)), self.ranges)  # rows of one text are dealt out
        for r in np.unique(where):
            at = np.flatnonzero(where == r)
            yield int(r), _pack(_DOCUMENTS, sig[at], n[at], np.ones(len(at)), ids[at], nulls[at])
        _, firsts = np.unique(sig, return_index=True)  # one of each class
        ends = np.cumsum(n)
        once = np.zeros(len(sig), bool)
        once[firsts] = True
        once &= n > 0
        doc = np.repeat(np.arange(len(sig)), n)
        keep = once[doc]
        h, doc = h[keep], doc[keep]
        del ends
        # hashes that are frequent here need no posting each
        o = np.argsort(h, kind="stable")
        run = np.flatnonzero(np.concatenate([[True], h[o][1:] != h[o][:-1]])) if len(h) else np.zeros(0, np.int64)
        length = np.diff(run, append=len(h))
        often = length >= max(64, int(once.sum()) // _FREQUENT)
        frequent = np.zeros(len(h), bool)
        frequent[o] = np.repeat(often, length)
        marked = h[o][run[often]]
        r = _range_of(marked, self.ranges)
        for k in np.unique(r):
            yield int(k), _pack(_MARKS, sig[:0], n[:0], n[:0], *_halves(marked[r == k]))
        for kind, chosen in ((_POSTINGS, ~frequent), (_FOUND, frequent)):
            hh, dd = h[chosen], doc[chosen]
            if not len(hh):
                continue
            ranges = _range_of(hh, self.ranges)
            r = ranges if kind == _POSTINGS else _bucket_of(sig, self.ranges)[dd]
            o = np.argsort(r * len(sig) + dd, kind="stable")
            hh, dd, r, ranges = hh[o], dd[o], r[o], ranges[o]
            group = np.flatnonzero(np.concatenate([[True], (dd[1:] != dd[:-1]) | (r[1:] != r[:-1])]))
            count = np.diff(group, append=len(hh))
            part = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            g_at = np.searchsorted(group, part)
            for i, (a, z) in enumerate(zip(part, [*part[1:], len(hh)], strict=True)):
                g = slice(g_at[i], g_at[i + 1] if i + 1 < len(part) else len(group))
                owner = dd[group[g]]
                more = () if kind == _POSTINGS else (ranges[a:z].astype(np.uint32), np.full(z - a, _MARKED, np.uint8))
                yield int(r[a]), _pack(kind, sig[owner], n[owner], count[g], *_halves(hh[a:z]), *more)


def _sets(df: DataFrame, size: int, ranges: int) -> DataFrame:
    """(range, payload) rows of all texts."""
    import pyarrow as pa

    names = ["range", "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=names)

    def run(batches):
        chunk = _Chunk(ranges)
        for b in batches:
            ids = b[0].fill_null(0).to_numpy(zero_copy_only=False)
            nulls = b[0].is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            texts = b[1].cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, side="right")) - 1)
                h, _, n, sig = shingle_sets(data[ends[at] : ends[end]], ends[at:end] - ends[at], size)
                chunk.add(ids[at:end], nulls[at:end], h, n, sig)
                at = end
                if chunk.total >= _CHUNK:
                    for row in chunk.rows():
                        yield batch([row])
                    chunk = _Chunk(ranges)
        for row in chunk.rows():
            yield batch([row])

    return df.mapInArrow(run, "range int, payload binary")


def _inverted(sets: DataFrame, ranges: int) -> DataFrame:
    """(bucket, payload): hashes that several classes have, back by class; and what only passes through."""
    import pyarrow as pa

    names = ["bucket", "payload"]

    def by_bucket(sig, n, h, r, weight):
        """Postings as payloads by bucket."""
        where = _bucket_of(sig, ranges)
        o = np.lexsort((sig, where))
        where, sig, n, h, weight = where[o], sig[o], n[o], h[o], weight[o]
        part = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for a, z in zip(part, [*part[1:], len(where)], strict=True):
            group = a + np.flatnonzero(np.concatenate([[True], sig[a + 1 : z] != sig[a : z - 1]]))
            yield int(where[a]), _pack(_FOUND, sig[group], n[group], np.diff(group, append=z), *_halves(h[a:z]), np.full(z - a, r, np.uint32), weight[a:z])

    def shared(h, sig, n, marks):
        """Of postings, those whose hash several classes have or that is marked, each class once, with weights."""
        o = np.argsort(h)
        h, sig, n = h[o], sig[o], n[o]
        run_at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(run_at, append=len(h))
        marked = np.isin(h[run_at], marks)
        chosen = np.repeat((length > 1) | marked, length)
        flag = np.repeat(marked, length)[chosen]
        h, sig, n = h[chosen], sig[chosen], n[chosen]
        o = np.lexsort((sig, h))
        h, sig, n, flag = h[o], sig[o], n[o], flag[o]
        keep = np.ones(len(h), bool)  # the same class from several tasks
        keep[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig, n, flag = h[keep], sig[keep], n[keep], flag[keep]
        run_at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        length = np.diff(run_at, append=len(h))
        each = np.repeat(length, length)
        chosen = (each > 1) | flag
        weight = np.where(flag, _MARKED, np.minimum(np.where(each < 128, each, 120 + np.log2(np.maximum(each, 1)).astype(np.int64)), _MARKED - 1)).astype(np.uint8)
        return sig[chosen], n[chosen], h[chosen], weight[chosen]

    def run(batches):
        postings, marks, r = [], [], 0
        for b in batches:
            for key, p in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                kind = p[0]
                if kind == _MARKS:
                    marks.append(_whole(*_unpack(p, _LISTS[kind])[3:]))
                elif kind == _POSTINGS:
                    r = key
                    postings.append(_unpack(p, _LISTS[kind]))
                else:  # its range was its bucket
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([p], pa.binary())], names=names)
        marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        parts = -(-sum(len(p[3]) for p in postings) // _AT_ONCE)
        for part in range(parts):
            h, sig, n = [], [], []
            for own, sizes, count, low, high in postings:
                at = np.flatnonzero((low.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32) == part) if parts > 1 else np.arange(len(low))
                owner = np.searchsorted(np.cumsum(count), at, side="right")
                h.append(_whole(low[at], high[at]))
                sig.append(own[owner])
                n.append(sizes[owner])
            found = shared(np.concatenate(h), np.concatenate(sig), np.concatenate(n), marks) if sum(map(len, h)) else ((),)
            del h, sig, n
            if len(found[0]):
                sig, n, h, weight = found
                for bucket, payload in by_bucket(sig, n, h, r, weight):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=names)

    return sets.repartitionById(ranges, F.col("range")).mapInArrow(run, "bucket int, payload binary")


_CLASSES = "is_document boolean, doc_id long, sig long, n int, own int, shared array<long>, weights array<short>, profile array<short>, parity array<long>"


def _classes(found: DataFrame, ranges: int, threshold: Fraction) -> DataFrame:
    """Documents (doc_id, sig, n), and candidate classes with the hashes they share, rarest first."""
    import pyarrow as pa

    names = [x.split()[0] for x in _CLASSES.split(", ")]
    p, q = threshold.numerator, threshold.denominator

    def run(batches):
        rows = []
        for payload in (p for b in batches for p in b[1].to_pylist()):
            if payload[0] == _FOUND:
                rows.append(_unpack(payload, _LISTS[_FOUND]))
            else:
                sig, n, _, ids, nulls = _unpack(payload, _LISTS[_DOCUMENTS])
                m = len(sig)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(ids, mask=nulls.astype(bool)), pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int16())), pa.nulls(m, pa.list_(pa.int16())), pa.nulls(m, pa.list_(pa.int64()))], names=names)
        if not rows:
            return
        sig_all, n_all, count = (np.concatenate([x[i] for x in rows]) for i in range(3))
        h = np.concatenate([_whole(x[3], x[4]) ^ _mix(x[5].astype(np.uint64)) for x in rows])
        weight = np.concatenate([x[6] for x in rows])
        rows.clear()
        sig, firsts, of = np.unique(sig_all, return_index=True, return_inverse=True)
        n = n_all[firsts].astype(np.int64)
        owner = np.repeat(of, count)
        o = np.lexsort((h, weight, owner))
        h, weight, owner = h[o], weight[o], owner[o]
        keep = np.ones(len(h), bool)  # a frequent hash comes from each task that has the class
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, weight, owner = h[keep], weight[keep], owner[keep]
        have = np.bincount(owner, minlength=len(sig))
        own = n - have
        good = own < n - -(-p * n // q) + 1
        mine = good[owner]
        h, weight, owner = h[mine], weight[mine], owner[mine]
        which = np.flatnonzero(good)
        ends = np.concatenate([[0], np.cumsum(have[which])])
        for a in range(0, len(which), 2000):
            w = which[a : a + 2000]
            e = ends[a : a + len(w) + 1]
            hs, ws = h[e[0] : e[-1]], weight[e[0] : e[-1]]
            off = pa.array((e - e[0]).astype(np.int32))
            at = np.repeat(np.arange(len(w)), np.diff(e))
            profile = np.zeros((len(w), _PROFILE), np.int64)
            np.add.at(profile, (at, (_mix(hs) % np.uint64(_PROFILE)).astype(np.int64)), 1)
            profile = np.minimum(profile, 32767).astype(np.int16)
            odd = np.zeros(len(w) * _PARITY * 64, np.uint8)
            np.add.at(odd, at * (_PARITY * 64) + (_mix(hs ^ _M3) % np.uint64(_PARITY * 64)).astype(np.int64), 1)  # wraps at 256, which is even
            parity = np.packbits(odd & 1).view(np.int64)
            m = len(w)
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, m * _PARITY + 1, _PARITY, dtype=np.int32)), pa.array(parity))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, bool)), pa.nulls(m, pa.int64()), pa.array(sig[w].view(np.int64)), pa.array(n[w].astype(np.int32)), pa.array(own[w].astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(hs.view(np.int64))), pa.ListArray.from_arrays(off, pa.array(ws.astype(np.int16))), pa.ListArray.from_arrays(pa.array(np.arange(0, m * _PROFILE + 1, _PROFILE, dtype=np.int32)), pa.array(profile.ravel())), words], names=names)

    return found.repartitionById(ranges, F.col("bucket")).mapInArrow(run, _CLASSES)


def _boundary(classes: DataFrame, threshold: float) -> int:
    """The largest size whose sets enumerate subsets: the least sum of subsets enumerated and postings scanned.

    A set of size n enumerates C(k + 1, 2) subsets of its k + 1 rarest shared hashes, or scans the lists of k of them;
    a set below the boundary also keeps its single hashes if one above can reach it. Costs are summed by size class,
    of which there are a few hundred at most.
    """
    k = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - F.col("own")
    size = F.floor(F.log(1.05, F.col("n"))).alias("size")
    scan = F.aggregate(F.slice("weights", F.lit(1), k.cast("int")), F.lit(0), lambda a, w: a + w)
    costs = classes.groupBy(size).agg(F.sum(k * (k + 1) / 2).alias("subsets"), F.sum(k).alias("postings"), F.sum(scan).alias("scan"), F.max("n").alias("most")).orderBy("size").collect()
    best, bound = None, 0
    for i in range(-1, len(costs)):
        edge = costs[i]["most"] if i >= 0 else 0
        cost = sum(float(c["subsets"]) for c in costs[: i + 1]) + sum(float(c["scan"]) for c in costs[i + 1 :]) + sum(float(c["postings"]) for c in costs if c["most"] >= threshold * edge)
        if best is None or cost < best:
            best, bound = cost, edge
    return bound


def _keys(classes: DataFrame, threshold: Fraction, bound: int) -> DataFrame:
    """(key, sig): the places of the index where each candidate stands."""
    import pyarrow as pa

    p, q = threshold.numerator, threshold.denominator

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                keys, sigs = [], []
                for sig, n, own, shared in zip(*(part[i].to_pylist() for i in range(4)), strict=True):
                    k = n - -(-p * n // q) + 1 - own
                    if n <= bound:
                        mine = [(x * 0x9E3779B97F4A7C15 + y) & (2**64 - 1) for x, y in combinations(sorted(shared[: k + 1]), 2)]
                        mine = [x - 2**64 if x >= 2**63 else x for x in mine]
                        if q * n >= p * bound:  # sizes above the boundary can reach it
                            mine += shared[:k]
                    else:
                        mine = shared[:k]
                    keys += mine
                    sigs += [sig] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64())], names=["key", "sig"])

    return classes.select("sig", "n", "own", "shared").mapInArrow(run, "key long, sig long")


def _linked(spark: SparkSession, pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b) of classes, those that link, with the size of their intersection. Staged."""
    pairs = staged(spark, pairs, "join-pairs")
    sets, sides = classes.select("sig", "n", "shared"), []

    def side(rows: DataFrame, name: str) -> DataFrame:
        # a class in very many pairs is no hot key: the heaviest are copied
        weights = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("w")).withColumnRenamed(name, "sig")
        right = sets.join(weights, "sig").select(F.col("sig").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"shared_{name}"), "w")
        sides.append(staged(spark, right, "join-side"))
        return lookup_wide(rows, sides[-1], name, "w").drop("w")

    both = side(side(pairs, "a"), "b")
    common = F.size(F.array_intersect("shared_a", "shared_b"))
    p, q = threshold.numerator, threshold.denominator
    rows = both.withColumn("common", common).where(F.lit(q) * F.col("common") >= F.lit(p) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    links = staged(spark, rows.select("a", "b", "common"), "join-links")
    discard(spark, pairs, *sides)
    return links


def _may_link(x: str, y: str, threshold: Fraction) -> Column:
    """Whether sizes, own hashes and profiles leave room for a link: the symmetric difference is at most (n + m)(1 - t)/(1 + t).

    It is at least the number of classes of hashes whose parities differ, which costs a few instructions, and at least the sum
    of what counts by class differ.
    """
    p, q = threshold.numerator, threshold.denominator
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.aggregate(F.zip_with(F.col(f"{x}.profile"), F.col(f"{y}.profile"), lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, d: s + d)
    own = F.col(f"{x}.own") + F.col(f"{y}.own")
    uneven = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(_PARITY)])
    room = lambda d: F.lit(p + q) * d <= F.lit(q - p) * (n + m)
    return (q * n >= p * m) & (q * m >= p * n) & room(own + uneven) & room(own + apart)


def near_classes(spark: SparkSession, df: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents (doc_id, sig, n); links (a, b, common) between classes, enough to connect all that link.

    df: doc_id, text. Both results are staged tables.
    """
    ship(spark)
    rows = columns_only(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    size_of_all = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(width(spark), -(-size_of_all // _RANGE_BYTES))
    table = staged(spark, _classes(_inverted(_sets(rows, size, ranges), ranges), ranges, threshold), "join-classes")
    documents = table.where("is_document").select("doc_id", "sig", "n")
    classes = table.where("not is_document").drop("is_document", "doc_id")

    bound = _boundary(classes, float(threshold))
    keys = _keys(classes, threshold, bound)
    info = classes.select("sig", "n", "own", "profile", "parity")
    keyed = staged(spark, keys.join(info.select("sig", (F.col("own") / F.col("n")).alias("share")), "sig"), "join-keys")
    lists = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("share", "sig")).alias("pivot")).where("m > 1")
    lists = staged(spark, lists.select("key", "m", F.col("pivot.sig").alias("pivot")), "join-lists")
    members = staged(spark, lookup(keyed.select("key", "sig"), lists, "key", "m").where("m is not null"), "join-members")
    discard(spark, keyed, lists)

    pair = (F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    first = _linked(spark, members.where("sig <> pivot").select(*pair).distinct(), classes, threshold)

    # What is still apart within a list: everything outside the pivot's component, against other components.
    roots = staged(spark, components(spark, first.select("a", "b")), "join-roots")
    rooted = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    pivots = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    by_pivot = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("w")).join(pivots, "pivot", "left")
    by_pivot = staged(spark, by_pivot.select("pivot", F.coalesce("pivot_root", "pivot").alias("pivot_root"), "w"), "join-pivots")
    rooted = lookup(rooted, by_pivot, "pivot", "w").withColumn("outside", F.col("root") != F.col("pivot_root"))
    rooted = staged(spark, rooted.select("key", "sig", "m", "root", "outside"), "join-rooted")
    discard(spark, members)
    mixed = rooted.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("apart"))
    parts = F.ceil(F.col("m") / 512).cast("int")  # long lists are compared in parts
    spread = staged(spark, lookup(rooted, mixed, "key", "apart").where("apart is not null").join(info, "sig").withColumn("parts", parts), "join-apart")
    discard(spark, rooted)
    x = spread.where("outside").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    y = spread.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).drop("parts")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.outside") | (F.col("x.sig") < F.col("y.sig")))
    more = x.alias("x").join(y.alias("y"), apart & _may_link("x", "y", threshold)).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    second = _linked(spark, more.distinct(), classes, threshold)
    return documents, first.unionByName(second)


def near_components(spark: SparkSession, df: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links; documents with an empty set stand alone. Staged."""
    with scratch(spark) as kept:
        out = staged(spark, _near_components(spark, df, size, threshold), "near-components")
        kept.append(out)
    return out


def _near_components(spark: SparkSession, df: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    documents, links = near_classes(spark, df, size, threshold)
    classes = documents.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = components(spark, links.select("a", "b"))
    classes = staged(spark, classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "join-of")
    by_root = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    named = lookup(classes, staged(spark, by_root, "join-by-root"), "root", "k").select("sig", "component_id", "copies")
    out = lookup(documents, staged(spark, named, "join-named"), "sig", "copies")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
