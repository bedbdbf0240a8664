"""Byte-level BPE with a segment tree over byte positions.

The leaf of a byte position holds the rank of the pair that the live token starting there forms with the next live
token, followed by the position; inner nodes hold the least of their leaves, so the root is the leftmost pair of least
rank. A merge changes three leaves (the merged token's, its left neighbour's, and the swallowed token's), each a walk
of logarithmic length to the root: n log n for a piece of n bytes, where a rescan for each merge would be quadratic.

Pieces of up to 64 bytes are merged many at a time, one tree a row of a matrix and one numpy step a tree level; longer
ones one by one. A worker keeps the pieces it has met in a dictionary bounded in bytes, so frequent words are merged
once. The vocabulary's file is read by the driver and sent to the workers.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import quoted
from scriptorium.llm.pretokens import BYTE_LEVEL, in_portions, splitter

#: Bytes in each of the two generations of a worker's cache, and those of a piece besides its characters.
CACHE_BYTES = 64 << 20
PIECE_BYTES = 200
_MANY_BYTES = 64
_NONE = np.iinfo(np.int32).max
_POSITION_BITS = 6
_ROWS = 4096


class Merges:
    """The vocabulary's merges: which pairs merge, in which order, into which token."""

    def __init__(self, byte_ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]], token_bytes: dict[int, bytes], whole: dict[bytes, int] | None):
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.pairs = pairs
        self.whole = whole or {}
        self.token_bytes = [token_bytes.get(i, b"") for i in range(max(token_bytes) + 1)]
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int32)[order]
        if self.ranks.max(initial=0) >= _NONE >> _POSITION_BITS:
            raise ValueError("too many merges for 32-bit tree nodes")
        self.made = np.zeros(int(self.ranks.max(initial=0)) + 1, dtype=np.int32)
        for rank, new in pairs.values():
            self.made[rank] = new

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, _NONE for those that don't merge."""
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (token := self.whole.get(piece)) is not None:
                out[i] = token.to_bytes(4, "little")
            elif len(piece) == 1:
                out[i] = int(self.byte_ids[piece[0]]).to_bytes(4, "little")
            elif len(piece) <= _MANY_BYTES:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
            elif piece:
                out[i] = np.array(self._one(piece), dtype="<u4").tobytes()
        for size, rows in by_size.items():
            for start in range(0, len(rows), _ROWS):
                part = rows[start : start + _ROWS]
                for i, ids in zip(part, self._many([pieces[i] for i in part], size)):
                    out[i] = ids
        return out

    def _many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of 2 to ``size`` bytes, a power of two; row r of every matrix belongs to piece r."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, size)
        ids = np.zeros((len(pieces), size + 1), dtype=np.int32)
        ids[:, :size] = self.byte_ids[raw]
        places = np.arange(size)
        live = places[None, :] < n[:, None]
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (len(pieces), size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), (len(pieces), size + 1)).copy()
        tree = np.full((len(pieces), 2 * size), _NONE, dtype=np.int32)
        rows, cols = np.nonzero(places[None, :] < n[:, None] - 1)
        self._set(tree, size, rows, cols, self.rank_of(ids[rows, cols], ids[rows, cols + 1]))
        level = size // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        rows = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(rows):
            least = tree[rows, 1]
            at = least & ((1 << _POSITION_BITS) - 1)
            gone = after[rows, at]
            right = after[rows, gone]
            left = before[rows, at]
            ids[rows, at] = self.made[least >> _POSITION_BITS]
            live[rows, gone] = False
            after[rows, at] = right
            has_right, has_left = right < n[rows], left >= 0
            tree[rows, size + gone] = _NONE
            tree[rows, size + at] = _NONE
            r, a, b = rows[has_right], at[has_right], right[has_right]
            before[r, b] = a
            self._set(tree, size, r, a, self.rank_of(ids[r, a], ids[r, b]))
            r, a, b = rows[has_left], left[has_left], at[has_left]
            self._set(tree, size, r, a, self.rank_of(ids[r, a], ids[r, b]))
            nodes = (size + gone, size + at, size + np.where(has_left, left, at))
            for _ in range(size.bit_length() - 1):
                nodes = tuple(x >> 1 for x in nodes)
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] != _NONE]
        packed = ids[:, :size][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [packed[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def _set(tree: np.ndarray, size: int, rows: np.ndarray, cols: np.ndarray, ranks: np.ndarray) -> None:
        tree[rows, size + cols] = np.where(ranks == _NONE, _NONE, (ranks << _POSITION_BITS) | cols)

    def _one(self, piece: bytes) -> list[int]:
        """One piece of any length."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (1 << 62, 0)
        pairs = self.pairs

        def leaf(a: int, b: int) -> tuple[int, int]:
            found = pairs.get((ids[a], ids[b]))
            return none if found is None else (found[0], a)

        tree = [none] * size + [leaf(i, i + 1) for i in range(n - 1)] + [none] * (size - n + 1)
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(position: int, value: tuple[int, int]) -> None:
            x = size + position
            tree[x] = value
            x >>= 1
            while x:
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least
                x >>= 1

        while tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at] = int(self.made[rank])
            ids[gone] = -1
            after[at] = right
            put(gone, none)
            if right < n:
                before[right] = at
                put(at, leaf(at, right))
            else:
                put(at, none)
            if left >= 0:
                put(left, leaf(left, at))
        return [t for t in ids if t >= 0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed token ids stand for."""
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


def merges_of_ranks(data: bytes) -> Merges:
    """A rank file: one base64 token and its rank a line; any two tokens merge whose joined bytes are a token."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = (rank, rank)
    return Merges([ranks[bytes([b])] for b in range(256)], pairs, {r: t for t, r in ranks.items()}, ranks)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level JSON vocabularies: printable bytes for themselves, the others
    for code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merges_of_json(data: bytes) -> Merges:
    """A JSON vocabulary with an ordered list of merges of token pairs."""
    model = json.loads(data)["model"]
    alphabet, vocab = byte_alphabet(), model["vocab"]
    spelled = {token: bytes(alphabet[c] for c in token) for token in vocab if all(c in alphabet for c in token)}
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    byte_of = {b: c for c, b in alphabet.items()}
    return Merges([vocab[byte_of[b]] for b in range(256)], pairs, {vocab[t]: s for t, s in spelled.items()}, None)


@lru_cache(maxsize=4)
def vocabulary(read: Callable[[bytes], Merges], data: bytes) -> Merges:
    """The merges of a vocabulary file's bytes, read once a process."""
    return read(data)


class PieceCache(dict):
    """Packed ids of pieces, kept by a worker between its tasks, in two generations of bounded size.

    When the young generation is full it becomes the old one, which is forgotten; what is used again moves back. It
    may exceed ``limit`` bytes by the pieces of one portion.
    """

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.bytes = limit, 0
        self.old: dict[str, bytes] = {}

    def fill(self, merges: Merges, pieces: set[str]) -> None:
        """Make sure that all of ``pieces`` are in the young generation."""
        if self.bytes > self.limit:
            self.old, self.bytes = dict(self), 0
            self.clear()
        missing = pieces.difference(self)
        self.bytes += PIECE_BYTES * len(missing) + 8 * sum(map(len, missing))
        if again := missing.intersection(self.old):
            self.update((p, self.old[p]) for p in again)
            missing -= again
        new = list(missing)
        self.update(zip(new, merges.encode([p.encode() for p in new])))


@lru_cache(maxsize=4)
def _cache(data: bytes, pattern: str) -> PieceCache:
    return PieceCache()


def encoded(docs: DataFrame, ranks_path: str, pattern: str = BYTE_LEVEL, keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """The columns ``keep`` plus n_tokens (long) and ids (binary: little-endian unsigned 32-bit), for every row.

    round_trip adds ``decoded`` (binary), the bytes that the ids decode to. Each match of ``pattern`` is merged by
    itself; there are no special tokens. Defined cases: a null or empty text has no tokens and decodes to no bytes; a
    text of any length is encoded whole; bytes that are not UTF-8 are read as replacement characters; repeated rows
    give repeated rows; an empty table gives an empty result; columns not in ``keep`` are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    # names of any kind stay outside: the workers see numbered columns
    wanted = docs.select(*(F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(keep)), F.make_valid_utf8("text").alias("of_text"))
    made = {"n_tokens": "long", "ids": "binary", **({"decoded": "binary"} if round_trip else {})}
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema if f.name != "of_text"} | made
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split, cache = vocabulary(merges_of_ranks, shipped.value), splitter(pattern), _cache(shipped.value, pattern)
        for batch in batches:
            kept, texts = batch.columns[:-1], [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for start, end in in_portions(texts):
                pieces = [split(t) for t in texts[start:end]]
                cache.fill(merges, set().union(*pieces))
                ids = [b"".join(map(cache.__getitem__, p)) for p in pieces]
                columns = [*(c.slice(start, end - start) for c in kept), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if round_trip:
                    columns.append(pa.array([merges.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return wanted.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items())).toDF(*keep, *made)
