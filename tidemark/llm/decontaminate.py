"""Benchmark decontamination with an FM-index for each training shard.

Words are maximal runs of [0-9a-z] and non-ASCII after A-Z are lowered. A window is ten
consecutive words of a benchmark item, or the whole item if it has fewer (but not none). A
document word inside any occurrence of a window is hit.

Each task cuts its documents into shards. A shard's text is the documents' words as numbers of the
benchmark's vocabulary; a word outside the vocabulary can't lie in a window, so it ends a run, and
runs shorter than the shortest window aren't indexed. The shard's FM-index is searched backward
for all windows at once, occurrences are located by sampled suffix positions, and their spans are
merged for each document. Documents never move between tasks, so a hot source or a passage that
a third of the documents share costs no skewed shuffle.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text, whose size is measured
first. With one block the documents are passed once. With more they are passed once for each
block, and the spans of a text are united by the text's hash.

Rows: null text and text without words give zero counts and no items. Repeated documents give
repeated rows. Items with null text have no window; items may repeat. Items
with null id are searched too and count as one item, null. Empty tables work. Only the
id and text columns are read, so extra or clashing columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, slices
from tidemark.llm.fm_index import FMIndex

WINDOW = 10
#: Benchmark text sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Symbols of one shard's index; a longer document is a shard of its own.
SHARD = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_LOWER).split()


class Phrases:
    """The distinct windows of a benchmark block, as numbers of its vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        place = {item: k for k, item in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for start in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[start : start + window]), set()).add(place[item])
        sizes = sorted({len(p) for p in owners})
        self.shortest = sizes[0] if sizes else 0
        #: for each length: matrix of windows, and the items of each window (offsets, places)
        self.groups = []
        for size in sizes:
            rows = [p for p in owners if len(p) == size]
            own = [sorted(owners[p]) for p in rows]
            self.groups.append((np.array(rows, np.int64), np.concatenate([[0], np.cumsum([len(o) for o in own])]), np.array([x for o in own for x in o], np.int64)))


def spans_of(shard: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """document -> (merged half-open word spans, items) for a shard's runs (document, first word, symbols)."""
    if not shard:
        return {}
    index = FMIndex([run for _, _, run in shard], len(phrases.number))
    document = np.array([d for d, _, _ in shard])
    offset = np.array([o for _, o, _ in shard])
    first, last, item = [], [], []
    for rows, begin, places in phrases.groups:
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        count = (high - low)[found]
        at = index.locate(np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
        which = np.repeat(found, count)
        own = begin[which + 1] - begin[which]
        first.append(at)
        last.append(np.full(len(at), rows.shape[1]))
        pairs = np.repeat(begin[which] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        run = np.searchsorted(index.start, np.repeat(at, own), "right") - 1
        item.append(np.unique(document[run] * np.int64(len(phrases.items)) + places[pairs]))
    if not first:
        return {}
    at, size = np.concatenate(first), np.concatenate(last)
    run = np.searchsorted(index.start, at, "right") - 1
    doc, start = document[run], at - index.start[run] + offset[run]
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], (start + size)[by]
    out, named = {}, np.unique(np.concatenate(item))
    edges = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        reach = np.maximum.accumulate(end[a:b])
        new = np.concatenate([[True], start[a:b][1:] > reach[:-1]])
        spans = np.stack([start[a:b][new], reach[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]], 1)
        own = named[np.searchsorted(named, doc[a] * len(phrases.items)) : np.searchsorted(named, (doc[a] + 1) * len(phrases.items))]
        out[int(doc[a])] = spans, own % len(phrases.items)
    return out


def batch_spans(texts: list[str | None], phrases: Phrases) -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Word counts of texts, and spans and items of those with a hit."""
    counts, shard, size, out = [], [], 0, {}
    number = phrases.number.get
    for d, text in enumerate(texts):
        own = words(text)
        counts.append(len(own))
        if len(own) < phrases.shortest or not phrases.shortest:
            continue
        symbols = np.fromiter((number(w, 0) for w in own), np.int64, len(own))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 0, [0]])))
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a >= phrases.shortest:
                shard.append((d, a, symbols[a:b]))
                size += b - a + 1
        if size >= SHARD:
            out.update(spans_of(shard, phrases))
            shard, size = [], 0
    out.update(spans_of(shard, phrases))
    return counts, out


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, [kept columns], n_words, spans array of [first, last) word, items array of strings sorted)."""
    blocks = list(_split(benchmark, item_column, item_text, block_bytes))
    names = [id_column, *[c for c in keep if c != id_column]]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    chosen = docs.select(*names, F.col(text_column).alias("_tm_text"))
    hits = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"
    if len(blocks) == 1:
        return chosen.mapInArrow(_mapper(blocks[0](), window, len(names), False), f"{fields}, {hits}")
    parts = None
    for block in blocks:
        found = chosen.select("_tm_text").mapInArrow(_mapper(block(), window, 0, True), f"_tm_key binary, {hits}")
        found = materialize(found.dropDuplicates(["_tm_key"]), "leaks")
        parts = found if parts is None else parts.unionByName(found)
    merged = (
        parts.groupBy("_tm_key")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("_tm_key", F.expr(_MERGE).alias("spans"), "items")
    )
    keyed = chosen.mapInArrow(_keyer(len(names)), f"{fields}, n_words long, _tm_key binary")
    none_spans, none_items = F.array().cast("array<struct<first:long,last:long>>"), F.array().cast("array<string>")
    return keyed.join(merged, "_tm_key", "left").select(*names, "n_words", F.coalesce("spans", none_spans).alias("spans"), F.coalesce("items", none_items).alias("items"))


_MERGE = """aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (acc, s) ->
  case when size(acc) > 0 and element_at(acc, -1).last >= s.first
       then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last))))
       else concat(acc, array(s)) end)"""


def _split(benchmark, item_column, item_text, most):
    """Functions that fetch one block each, so that the driver holds one at a time."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    total = items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    blocks = 1 if total <= most else -(-2 * total // most)

    def fetch(k):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        return [(r.item, r.body) for r in part.collect()]

    return [lambda k=k: fetch(k) for k in range(blocks)]


_PHRASES: dict = {}


def _phrases(items: list, window: int) -> Phrases:
    key = (window, hashlib.sha256(repr(items).encode()).digest())
    if key not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[key] = Phrases(items, window)
    return _PHRASES[key]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _mapper(items: list, window: int, kept: int, keyed: bool):
    """Maps (kept columns, text) to spans; keyed: to the hit texts' hashes instead of columns."""

    def run(batches):
        phrases = _phrases(items, window)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(kept).to_pylist()
                counts, found = batch_spans(texts, phrases)
                rows = sorted(found) if keyed else range(len(texts))
                spans = [[{"first": a, "last": b} for a, b in found[d][0].tolist()] if d in found else [] for d in rows]
                own = [[phrases.items[k] for k in found[d][1].tolist()] if d in found else [] for d in rows]
                columns = [pa.array([_key(texts[d]) for d in rows], pa.binary())] if keyed else batch.columns[:kept]
                names = ["_tm_key"] if keyed else batch.schema.names[:kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([counts[d] for d in rows], pa.int64()), pa.array(spans, _SPANS), pa.array(own, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    return run


def _key(text: str | None) -> bytes:
    return b"" if text is None else xxhash.xxh3_128_digest(text.encode())


def _keyer(kept: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(kept).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([len(words(t)) for t in texts], pa.int64()), pa.array([_key(t) for t in texts], pa.binary())], names=[*batch.schema.names[:kept], "n_words", "_tm_key"])

    return run


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def without(text: str, spans: list[dict]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    place = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : place[s["first"]][0]])
        at = place[s["last"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def cut_text(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the text of benchmark windows; null text stays null.

    With one block of benchmark text, found and cut in the same pass.
    """
    names = docs.columns
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    at, last = names.index(text_column), len(names)
    blocks = list(_split(benchmark, item_column, item_text, block_bytes))

    def replaced(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        columns = list(batch.columns[:last])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    if len(blocks) == 1:
        items = blocks[0]()

        def run(batches):
            phrases = _phrases(items, window)
            for whole in batches:
                for batch in slices(whole):
                    texts = batch.column(at).to_pylist()
                    for d, (spans, _) in batch_spans(texts, phrases)[1].items():
                        texts[d] = without(texts[d], [{"first": a, "last": b} for a, b in spans.tolist()])
                    yield replaced(batch, texts)

        return docs.mapInArrow(run, fields)

    def cut(batches):
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)
            yield replaced(batch, [without(t, s) if s else t for t, s in rows])

    found = find(docs, benchmark, names[0], text_column, item_column, item_text, window, block_bytes, keep=tuple(names))
    return found.select(*names, "spans").mapInArrow(cut, fields)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """find()'s rows as counts and digests."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        id_column,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
