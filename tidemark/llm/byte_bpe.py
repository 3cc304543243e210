"""Byte-level BPE by rounds over padded matrices.

The distinct pieces of a batch are laid out as rows of numpy matrices, one matrix for each
length bucket, padded with -1. In every round each row merges its leftmost pair of least rank;
pair ranks come from an open-addressing hash table, rows close up after a merge, and rows
without a pair leave the matrix.

Pieces beyond WIDE bytes would need as many rounds as merges, so each such row merges all its
disjoint occurrences of the least pair in a round; if that round made a pair of lower rank, only
the leftmost occurrence is merged, as the one-by-one order asks. Both give the same ids.

Rows: null text counts as empty (no ids, no bytes). Repeated rows and ids give repeated results;
an empty table gives an empty result; columns that aren't named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch

NONE = np.int32(2**31 - 1)
#: Rows longer than this take the many-merges-a-round way.
WIDE = 128
#: Cells of one matrix.
CELLS = 1 << 19
#: Buckets of piece lengths, in bytes.
EDGES = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, WIDE)
#: Pieces that a worker remembers.
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairRanks:
    """(left id, right id) -> rank of the joined bytes, by hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - self.bits)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]] = keys[first]
            self.ranks[at[first]] = values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
        self.mask = size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where an id is negative (padding) or the pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        at = self._slot(flat)
        there = self.keys[at]
        out = np.where(there == flat, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != flat) & (there != -1) & (flat != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == flat[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out.reshape(keys.shape)


class ByteBPE:
    """Encoder and decoder over rank bytes such as those of a .tiktoken file."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.pairs = PairRanks(self.ranks)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        known = self.known
        new = {piece for pieces in split for piece in pieces if piece not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {piece for pieces in split for piece in pieces}
        self._learn(list(new))
        return [b"".join([known[piece] for piece in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _learn(self, pieces: list[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.known[piece] = self._merge_wide(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault(EDGES[bisect_left(EDGES, len(raw))], []).append((piece, raw))
        for width, rows in buckets.items():
            for start in range(0, len(rows), step := max(1, CELLS // width)):
                part = rows[start : start + step]
                for (piece, _), ids in zip(part, self._merge_rows([raw for _, raw in part], width), strict=True):
                    self.known[piece] = ids

    def _merge_rows(self, raws: list[bytes], width: int) -> list[bytes]:
        count = np.array([len(raw) for raw in raws])
        cells = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < count[:, None], self.of_byte[cells], np.int32(-1))
        pairs = self.pairs(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(raws)), [b""] * len(raws)
        while len(row):
            if not pairs.shape[1]:
                _take(out, row, ids, count[row])
                break
            at = pairs.argmin(axis=1)  # the leftmost of equal ranks
            best = pairs[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                _take(out, row[done], ids[done], count[row[done]])
                go = ~done
                row, ids, pairs, at, best = row[go], ids[go], pairs[go], at[go], best[go]
                if not len(row):
                    break
                most = int(count[row].max())
                ids, pairs = ids[:, :most].copy(), pairs[:, : most - 1].copy()
            n, wide = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, wide), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, wide - 1)  # every row gives up one cell
            keep = np.ones((n, wide - 1), bool)
            keep[line, at] = False
            pairs = pairs[keep].reshape(n, wide - 2)
            right, left = np.flatnonzero(at < wide - 2), np.flatnonzero(at > 0)
            pairs[right, at[right]] = self.pairs(best[right], ids[right, at[right] + 1])
            pairs[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], best[left])
            count[row] -= 1
        return out

    def _merge_wide(self, raw: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        pairs = self.pairs(ids[:-1], ids[1:])
        while len(pairs) and (least := pairs.min()) != NONE:
            found = np.flatnonzero(pairs == least)
            start = np.concatenate([[True], np.diff(found) > 1])
            since = np.arange(len(found)) - np.maximum.accumulate(np.where(start, np.arange(len(found)), 0))
            merged = self._merge_at(ids, pairs, found[since % 2 == 0], least)
            if merged is None:
                merged = self._merge_at(ids, pairs, found[:1], least, force=True)
            ids, pairs = merged
        return ids

    def _merge_at(self, ids, pairs, at, least, force=False):
        """ids and pairs after the merges; None if one of them made a pair of lower rank."""
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = np.where(np.isin(np.arange(len(ids)), at, assume_unique=True), least, ids) if len(at) < 8 else _put(ids, at, least)
        place = np.cumsum(keep) - 1
        ids, new = ids[keep], place[at]
        pairs = pairs[keep[1:]]  # the pair that starts at a kept right end
        pairs = pairs[: len(ids) - 1]
        near = np.unique(np.concatenate([new, new - 1]))
        near = near[(near >= 0) & (near < len(ids) - 1)]
        pairs[near] = self.pairs(ids[near], ids[near + 1])
        if not force and len(near) and pairs[near].min() < least:
            return None
        return ids, pairs


def _take(out: list[bytes], row: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
    raw, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
    for i, (r, n) in enumerate(zip(row.tolist(), count.tolist(), strict=True)):
        out[r] = raw[i * size : i * size + 4 * n]


def _put(ids: np.ndarray, at: np.ndarray, value) -> np.ndarray:
    ids = ids.copy()
    ids[at] = value
    return ids


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(rank_file, pattern)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, token_ids binary): ids of every whole text, little-endian unsigned 32-bit."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoder(rank_file, pattern).encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_column, "token_ids"])

    return docs.select(id_column, text_column).mapInArrow(per_batch(run), f"`{id_column}` {kind}, token_ids binary")


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, decoded binary) from encode()'s rows; null ids give null."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _encoder(rank_file, pattern)
        raw = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_column, "decoded"])

    return encoded.select(id_column, "token_ids").mapInArrow(per_batch(run), f"`{id_column}` {kind}, decoded binary")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """encode() and decode() in one pass, as digests: (id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _encoder(rank_file, pattern)
        rows = own.encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) // 4 for x in rows], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in rows], pa.string()),
            ],
            names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(id_column, F.col(text_column)).mapInArrow(per_batch(run), f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
