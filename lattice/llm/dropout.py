"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the agenda of byte-pair encoding over a vocabulary with scores: of all neighbouring symbols
whose joined text is a piece, the pair with the best score (the leftmost, if several have it) is merged, until none
is left. With dropout p, a candidate is skipped for good when a keyed hash falls below p; the hash covers the seed, the
document's key and the characters where the pair's halves begin and end. So segmentations vary from document to
document and from seed to seed, and are the same on every run, whatever the partitions.

Words cannot merge with each other (no piece holds a space after another character), so a batch's words run their
agendas side by side in numpy, one merge a word and round; stretches of over _LONG symbols use a heap.

Characters that are no piece become byte pieces, and so does a literal U+2581, the mark that stands for a space;
decoding therefore gives every text back exactly. With dropout 0 the ids equal the library's (for texts without U+2581).
Nulls count as empty text, which has no ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, ship, text_of

_MARK = "▁"
_LONG = 160
_CHARS = 1 << 17  # characters whose words run side by side
_NONE = np.int64(1) << 60
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


class _PairTable:
    """(left, right) to (rank, merged): two places for each key, so a lookup is two reads."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, int(np.ceil(np.log2(3 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.rank = np.array([r for r, _ in pairs.values()] + [0], np.int64)
        self.merged = np.array([m for _, m in pairs.values()] + [0], np.int32)
        keys = np.array([a << 16 | b for a, b in pairs], np.int64)
        places = np.stack([self._place(keys, 0), self._place(keys, 1)], axis=1).tolist()
        table: dict[int, int] = {}
        for i in range(len(keys)):
            k, side = i, 0
            for _ in range(500):
                p = places[k][side]
                other = table.get(p)
                table[p] = k
                if other is None:
                    break
                k, side = other, 1 - places[other].index(p) if places[other][0] != places[other][1] else 0
            else:
                raise ValueError("the pair table is too small")
        for p, i in table.items():
            self.keys[p], self.at[p] = keys[i], i

    def _place(self, keys: np.ndarray, which: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * (_M1 if which == 0 else _M4)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in rank and merged, or -1."""
        keys = left.astype(np.int64) << 16 | right
        p = self._place(keys, 0)
        out = np.where(self.keys[p] == keys, self.at[p], -1)
        open_ = np.flatnonzero(out < 0)
        q = self._place(keys[open_], 1)
        out[open_] = np.where(self.keys[q] == keys[open_], self.at[q], -1)
        return out


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = {names[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(_MARK in t.lstrip(_MARK) for t in plain) or n > 1 << 16:
            raise ValueError("this encoder needs pieces that hold spaces only at their start, 65,536 at most")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        level = {s: i for i, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        pairs = {}
        for t, i in plain.items():
            for cut in range(1, len(t)):
                a, b = plain.get(t[:cut]), plain.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = level[sp.get_score(i)], i
        self.pairs = _PairTable(pairs)
        self.scalar = pairs
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[:128] = self.byte[:128]
        for t, i in plain.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        self.symbol[ord(" ")], self.symbol[ord(_MARK)] = plain[_MARK], -1
        self.mark = plain[_MARK]
        self.alone = np.zeros(n + 1, bool)  # symbols that never merge; the last entry is for -1
        self.alone[self.byte] = True
        self.alone[-1] = True
        text = {i: t.replace(_MARK, " ").encode() for t, i in plain.items()}
        self.bytes = [bytes([int(np.flatnonzero(self.byte == i)[0])]) if sp.is_byte(i) else text.get(i, b"") for i in range(n)]

    def _skipped(self, dropout: float, key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the candidates that span [a, b) and [b, c) of documents with these keys are skipped."""
        h = key + a.astype(np.uint64) * _M1 + b.astype(np.uint64) * _M2 + c.astype(np.uint64) * _M3
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M3
        return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53

    def _by_heap(self, ids: list[int], dropout: float, key: np.uint64, start: int) -> list[tuple[int, int]]:
        """The agenda of one stretch, symbol by symbol: (position, id) of what is left."""
        n = len(ids)
        ids, begin, after, before = list(ids), [*range(n)], [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda: list = []

        def propose(x: int, y: int) -> None:
            if x >= 0 and y < n and (found := self.scalar.get((ids[x], ids[y]))):
                heapq.heappush(agenda, (found[0], x, y, ids[x], ids[y], found[1]))

        for i in range(n - 1):
            propose(i, i + 1)
        with np.errstate(over="ignore"):
            while agenda:
                _, x, y, a, b, merged = heapq.heappop(agenda)
                if ids[x] != a or ids[y] != b or after[x] != y or ids[y] < 0:
                    continue
                if dropout and self._skipped(dropout, np.uint64(key), np.array([start + x]), np.array([start + y]), np.array([start + after[y]]))[0]:
                    continue
                ids[x], ids[y], after[x] = merged, -2, after[y]
                if after[x] < n:
                    before[after[x]] = x
                propose(before[x], x)
                propose(x, after[x])
        return [(begin[i], ids[i]) for i in range(n) if ids[i] != -2]

    def encode(self, texts: list[str], dropout: float = 0.0, keys: list[int] | None = None) -> list[np.ndarray]:
        """Ids of each text; keys (64 bits) tell documents apart where dropout is over 0."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _CHARS):
                size += len(texts[end]) + 1
                end += 1
            with np.errstate(over="ignore"):
                out += self._encode(texts[at:end], dropout, np.array(keys[at:end] if keys else [0] * (end - at), np.uint64))
            at = end
        return out

    def _encode(self, texts: list[str], dropout: float, doc_keys: np.ndarray) -> list[np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts])
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        sym = self.symbol[codes]
        n = len(sym)
        if not n:
            return [np.empty(0, np.int32) for _ in texts]
        first = np.zeros(n, bool)  # of a stretch that nothing merges into
        blank, alone = sym == self.mark, self.alone[sym]
        first[1:] = blank[1:] & ~blank[:-1] | alone[1:] | alone[:-1]
        first[(ends - lengths)[lengths > 0]] = True
        result = np.where(alone, sym, -3).astype(np.int32)  # -1: bytes; -3: inside a piece
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=n)
        single = sizes == 1
        result[starts[single]] = sym[starts[single]]
        if dropout:
            doc_of = np.repeat(np.arange(len(texts)), lengths)
            key_at, origin = doc_keys[doc_of], (ends - lengths)[doc_of]
        for s, size in zip(starts[sizes > _LONG].tolist(), sizes[sizes > _LONG].tolist(), strict=True):
            key, zero = (key_at[s], int(s - origin[s])) if dropout else (np.uint64(0), 0)
            for i, piece in self._by_heap(sym[s : s + size].tolist(), dropout, key, zero):
                result[s + i] = piece
        chosen = (sizes > 1) & (sizes <= _LONG)
        begin, size = starts[chosen], sizes[chosen]
        if len(begin):
            # symbols of the words still open: position, id, and the candidate with the symbol to the right
            word_at = np.concatenate([[0], np.cumsum(size)[:-1]])
            pos = np.repeat(begin - word_at, size) + np.arange(size.sum())
            ids = sym[pos]
            stop = np.concatenate([pos[1:], [0]])  # where the symbol ends
            last = word_at + size - 1
            stop[last] = begin + size

            def candidates(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Of symbols i with their right neighbours: rank and merged id."""
                found = self.pairs.find(ids[i], ids[i + 1])
                value = np.where(found >= 0, self.pairs.rank[found], _NONE)
                if dropout:
                    hit = np.flatnonzero(found >= 0)
                    j = i[hit]
                    p = pos[j]
                    o = origin[p]
                    value[hit[self._skipped(dropout, key_at[p], p - o, pos[j + 1] - o, stop[j + 1] - o)]] = _NONE
                return value, self.pairs.merged[found]

            cand, made = np.full(len(ids), _NONE), np.zeros(len(ids), np.int32)
            inner = np.ones(len(ids), bool)
            inner[last] = False
            i = np.flatnonzero(inner)
            cand[i], made[i] = candidates(i)
            while True:
                best = np.minimum.reduceat(cand, word_at)
                live = best < _NONE
                if not live.all():  # words that are done leave
                    keep = np.repeat(live, size)
                    done = ~keep
                    result[pos[done]] = ids[done]
                    pos, ids, stop, cand, made = pos[keep], ids[keep], stop[keep], cand[keep], made[keep]
                    size, best = size[live], best[live]
                    if not len(size):
                        break
                    word_at = np.concatenate([[0], np.cumsum(size)[:-1]])
                # the leftmost symbol of each word whose candidate is the best
                match = np.flatnonzero(cand == np.repeat(best, size))
                word = np.searchsorted(word_at, match, side="right") - 1
                take = match[np.concatenate([[True], word[1:] != word[:-1]])]
                ids[take] = made[take]
                stop[take] = stop[take + 1]
                keep = np.ones(len(ids), bool)
                keep[take + 1] = False
                pos, ids, stop, cand, made = pos[keep], ids[keep], stop[keep], cand[keep], made[keep]
                take = take - np.arange(len(take))
                size = size - 1
                word_at = word_at - np.arange(len(word_at))
                right = take[take < word_at + size - 1]
                left = take[take > word_at] - 1
                cand[take] = _NONE
                again = np.concatenate([left, right])
                if len(again):
                    cand[again], made[again] = candidates(again)
        return self._split(result, codes, ends)

    def _split(self, result: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids by document, characters without a piece spelled in bytes."""
        where = np.flatnonzero(result != -3)
        ids = result[where]
        if (unknown := np.flatnonzero(ids == -1)).size:
            c = codes[where[unknown]].astype(np.int64)
            width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            times = np.ones(len(ids), np.int64)
            times[unknown] = width
            spelled = np.frombuffer("".join(map(chr, c.tolist())).encode(), np.uint8)
            hole = np.repeat(ids == -1, times)
            ids, where = np.repeat(ids, times), np.repeat(where, times)
            ids[hole] = self.byte[spelled]
        return np.split(ids, np.searchsorted(where, ends)[:-1]) if len(ends) else []

    def decode(self, ids) -> str:
        """The text that has these ids."""
        table = self.bytes
        return b"".join([table[i] for i in ids])[1:].decode()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _rows(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """doc_id, text and the document's key: a hash of id, text, seed and epoch."""
    return columns_only(df, "doc_id", "text").select("doc_id", text_of("text").alias("text"), F.xxhash64(F.lit(seed), F.lit(epoch), F.col("doc_id").cast("long"), text_of("text")).alias("key"))


def _encoded(batch, model: str, dropout: float, at_once: int = 400):
    e = encoder(model)
    for at in range(0, batch.num_rows, at_once):
        part = batch.slice(at, at_once)
        texts = part[1].to_pylist()
        yield part, texts, e.encode(texts, dropout, [k & (2**64 - 1) for k in part[2].to_pylist()]), e


def encode(spark: SparkSession, df: DataFrame, model: str, dropout: float = 0.1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """doc_id, ids: one segmentation of each whole text. Nothing is shuffled."""
    import pyarrow as pa

    ship(spark)

    def run(batches):
        for b in batches:
            for part, _, ids, _ in _encoded(b, model, dropout):
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part[0].cast(pa.int64()), lists], names=["doc_id", "ids"])

    return _rows(df, seed, epoch).mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, df: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); a null list decodes to an empty text."""
    import pyarrow as pa

    ship(spark)

    def run(batches):
        e = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.int64()), pa.array([e.decode(x) if x else "" for x in b[1].to_pylist()], pa.string())], names=["doc_id", "text"])

    return columns_only(df, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, df: DataFrame, model: str, dropout: float = 0.1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit little endian), lossless: each text encoded and decoded."""
    import pyarrow as pa

    ship(spark)

    def run(batches):
        for b in batches:
            for part, texts, ids, e in _encoded(b, model, dropout):
                n = pa.array([len(x) for x in ids], pa.int64())
                digest = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
                same = pa.array([e.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part[0].cast(pa.int64()), n, digest, same], names=["doc_id", "n_tokens", "ids_sha256", "lossless"])

    return _rows(df, seed, epoch).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, lossless boolean")
