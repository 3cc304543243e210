"""Near-duplicate classes by Order MinHash.

A text's words are its lowered runs between white space, its k-mers five-word shingles (fewer than
five words make one), each labelled with its occurrence number. A sketch takes the KMERS least-hashed
labelled k-mers under one hash function and keeps them in text order; two texts share a sketch the
likelier the smaller their edit distance. BANDS sketches make a text's blocking keys.

Candidates are verified by banded alignment of the words: M is the longest common subsequence of
both word sequences within the diagonals that a similar pair can use (a bit-parallel dynamic
programme over a sliding window), and the similarity is M / (|A| + |B| - M): Jaccard similarity that
counts order and repetition. Links join pairs of SIMILARITY or more; classes are their components.
At that similarity random edits leave two texts 0.38 of their k-mers or more; such a pair shares no
key with a chance of 0.7 %, at 0.5 of the k-mers of 0.01 %.

Identical texts are one node throughout. In a bucket of texts with a common key each is first
compared with the bucket's hub, the text that shares the most keys with others; components follow.
Buckets that still hold several components, such as a crowd that shares a passage but is not alike,
are compared in tiles of bounded size: a tile holds signatures only (SIGNATURE least hashes of the
occurrence-labelled words, a byte each), and pairs of different components are near if both lengths
allow the similarity and EQUAL of the hashes agree. The Jaccard similarity of labelled words is an
upper bound of the aligned one; a pair at 0.8 has fewer with a chance under 0.1 %. Each component's
nearest pairs in a tile are aligned first, and what components remain then over all their near
pairs, each in the bucket of its least common key. So no bucket is expanded into pairs of texts that
are known to be in one class or are far from alike, no task holds an unbounded bucket, and no text
is dropped. The comparisons of signatures in a crowd grow with the square of its distinct texts,
spread over its tiles.

Rows: null text is in a class of its own (its doc_id). Texts without a word are only alike when
identical. The class id is the least doc_id of the class, or null if all are null. Repeated rows
share their class. Empty tables work. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bloom, discard, materialize, maybe, slices
from tidemark.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of a text, and k-mers of each.
BANDS, KMERS = 32, 2
#: Least hashes in a signature, and how many must agree before two texts of a crowd are aligned.
SIGNATURE, EQUAL = 256, 184
#: Pairs of a component and tile that are aligned before all others.
NEAREST = 4
#: Texts of a tile's side.
TILE = 2048
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240229)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SCALE = _rng.integers(1, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, SIGNATURE, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the text's words in order."""
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    return np.array([_WORDS[w] for w in text.lower().split()], np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a sequence of word hashes, in order."""
    size = len(hashes)
    if not size:
        return hashes
    if size < SHINGLE:
        return _mix(np.array([np.bitwise_xor.reduce(_mix(hashes * _STEP[:size])) + np.uint64(size)]))
    n = size - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += hashes[k : k + n] * _STEP[k]
    return _mix(out)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with their occurrence numbers."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return kmers
    line = np.arange(len(kmers))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), line, 0))
    times = np.empty(len(kmers), np.uint64)
    times[order] = line - first
    return np.where(times > 0, _mix(kmers + times * _M1), kmers)


def _hashed(low: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows first to last of the hash functions over 32-bit k-mers."""
    values = low * _SCALE[first:last, None] + _SHIFT[first:last, None]
    values ^= values >> np.uint32(15)
    values *= np.uint32(0x2C1B3C6D)
    values ^= values >> np.uint32(12)
    return values


def sketch_keys(kmers: np.ndarray) -> np.ndarray:
    """The blocking keys of a text's k-mers."""
    n = len(kmers)
    if not n:
        return np.empty(0, np.int64)
    own = labelled(kmers)
    low = own.astype(np.uint32)
    size, step = min(KMERS, n), max(1, (1 << 18) // n)
    chosen = []
    for a in range(0, BANDS, step):
        values = _hashed(low, a, min(a + step, BANDS))
        line, places = np.arange(len(values)), np.empty((len(values), size), np.int64)
        for k in range(size):
            places[:, k] = values.argmin(axis=1)
            values[line, places[:, k]] = np.uint32(0xFFFFFFFF)
        chosen.append(own[np.sort(places, axis=1)])
    chosen = np.concatenate(chosen)
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 * size)
    for k in range(size):
        keys = _mix(keys * _M2 + chosen[:, k])
    return keys.view(np.int64)


def signature(words: np.ndarray) -> bytes:
    """A byte of the least hash of the occurrence-labelled words under each of SIGNATURE functions."""
    if not len(words):
        return bytes(SIGNATURE)
    low = labelled(words).astype(np.uint32)
    step = max(1, (1 << 18) // len(low))
    return b"".join(_hashed(low, a, a + step).min(axis=1).astype(np.uint8).tobytes() for a in range(0, SIGNATURE, step))


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence that stays within band diagonals of the main one."""
    places: dict[int, int] = {}
    for j, s in enumerate(b):
        places[s] = places.get(s, 0) | 1 << j
    width = 2 * band + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    columns, matched = mask, 0  # a zero bit marks a column that adds one
    for i, s in enumerate(a):
        if i:
            if not columns & 1:
                matched += 1
            columns = columns >> 1 | top
        found = places.get(s, 0)
        if found:
            found = (found >> (i - band) if i > band else found << (band - i)) & mask
            hit = columns & found
            columns = ((columns + hit) | (columns - hit)) & mask
    return matched + width - columns.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """M / (|A| + |B| - M) by banded alignment of word hashes, or 0 where it is sure to be under least."""
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if not total or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    if a.tobytes() == b.tobytes():
        return 1.0
    _, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    kinds = number.max() + 1
    common = np.minimum(np.bincount(number[: len(a)], minlength=kinds), np.bincount(number[len(a) :], minlength=kinds))
    if common.sum() < need - 1e-9:
        return 0.0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    rest = n - head
    tail = 0
    if rest:
        same = a[len(a) - rest :][::-1] == b[len(b) - rest :][::-1]
        tail = rest if same.all() else int(same.argmin())
    band = int((1 - least) / (1 + least) * total + 1e-9)
    m = head + tail + aligned(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), band)
    return m / (total - m)


def text_node(text: Column) -> Column:
    """128-bit hash of a text; null for null."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            rows = [word_hashes(t) for t in batch.column(2).to_pylist()]
            keys = pa.array([sketch_keys(shingles(r)) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in rows], pa.int32()), keys], names=["doc_id", "node", "words", "keys"])


def _wanted(filter_: np.ndarray, made):
    """(node, value) of the texts that may be wanted; made gives the value of a sequence of word hashes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                batch = batch.filter(pa.array(maybe(filter_, batch.column(1).to_numpy(zero_copy_only=False))))
                if not batch.num_rows:
                    continue
                values = pa.array([made(word_hashes(t)) for t in batch.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["node", "value"])

    return run


def _verified(least: float):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [
                    similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    texts = docs.select(text_node(F.col("text")).alias("node"), "text").where("node is not null")
    return texts.select("node", F.xxhash64("node").alias("k"), "text")


def _values(docs: DataFrame, nodes: DataFrame, made, label: str) -> DataFrame:
    """(node, value) of the nodes, written; nodes is a written table."""
    wanted = nodes.withColumn("k", F.xxhash64("node"))
    found = _texts(docs).mapInArrow(_wanted(bloom(wanted, "k"), made), "node binary, value binary")
    found = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("value").alias("value"))
    return materialize(found, label)


def _links(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar; pairs is a written table."""
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    nodes = materialize(ends.distinct(), "nodes")
    sequences = _values(docs, nodes, lambda words: words.tobytes(), "sequences")
    first = sequences.select(F.col("node").alias("a"), F.col("value").alias("x"))
    second = sequences.select(F.col("node").alias("b"), F.col("value").alias("y"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    links = both.mapInArrow(_verified(least), "a binary, b binary, similarity double").where(F.col("similarity") >= least)
    links = materialize(links.select("a", "b"), "links")
    discard(sequences, nodes)
    return links


def _alike(least: float) -> Column:
    """Whether both counts of words allow the similarity."""
    return F.least("words", "other_words") >= F.lit(least) * F.greatest("words", "other_words")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, words, weight) of keys that two nodes or more have; weight counts the texts a node meets."""
    members = nodes.select("node", "words", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(members.join(shared, "key"), "met")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    members = materialize(met.join(weights, "node").select("key", "node", "words", "weight"), "members")
    discard(met)
    return members


def _stars(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of each node with the hub of its buckets, a > b."""
    hubs = members.groupBy("key").agg(F.max(F.struct("weight", "node", "words")).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.words").alias("other_words"))
    met = members.join(hubs, "key").where(F.col("node") != F.col("hub")).where(_alike(least))
    return met.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members of buckets with several components, with their component and the bucket's size n."""
    placed = members.join(roots, "node", "left").select("key", "node", "words", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return materialize(placed.join(several.select("key", "n"), "key"), "split")


def _tiles(split: DataFrame, signatures: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of split buckets' nodes, in different components (a_root, b_root) and near enough to be aligned.

    A bucket of n texts is cut into n / TILE blocks; a tile compares two of them, inside one task.
    nearest: just the NEAREST nearest pairs of each component and tile.
    """
    count = F.ceil(F.col("n") / TILE).cast("int")
    block = F.pmod(F.xxhash64("node"), count).cast("int")
    keys = split.groupBy("node").agg(F.collect_list("key").alias("keys"))  # as many as sketches at most
    rows = split.join(signatures, "node").join(keys, "node").withColumn("block", block)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "root", "words", "value", "keys")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compared(least, nearest), "a binary, b binary, a_root binary, b_root binary").distinct()


def _compared(least: float, nearest: bool):
    def solve(rows: list[tuple]) -> list[tuple]:
        """(equal hashes, a, b, root of a, root of b)"""
        key, i, j = rows[0][:3]
        left, right = ([r for r in rows if r[3] == side] for side in (i, j))
        if not left or not right:
            return []
        right.sort(key=lambda r: r[6])
        signatures = np.frombuffer(b"".join(r[7] for r in right), np.uint8).reshape(len(right), -1)
        words = np.array([r[6] for r in right])
        kinds: dict[bytes, int] = {}
        roots = np.array([kinds.setdefault(r[5], len(kinds)) for r in right])
        keys = [set(r[8]) for r in right]
        found = []
        for r in left:
            low, high = np.searchsorted(words, least * r[6] - 1e-9, "left"), np.searchsorted(words, r[6] / least + 1e-9, "right")
            other = low + np.flatnonzero(roots[low:high] != kinds.get(r[5], -1))
            if not len(other):
                continue
            equal = (signatures[other] == np.frombuffer(r[7], np.uint8)).sum(axis=1)
            if nearest:
                best = np.argsort(-equal, kind="stable")[:NEAREST]
                chosen = [(n, k) for n, k in zip(equal[best].tolist(), other[best].tolist(), strict=True) if n >= EQUAL]
            else:
                near = np.flatnonzero(equal >= EQUAL)
                own = set(r[8])
                chosen = [(n, k) for n, k in zip(equal[near].tolist(), other[near].tolist(), strict=True) if (i != j or r[4] > right[k][4]) and min(own & keys[k]) == key]
            for n, k in chosen:
                x, y = (r[4], r[5]), (right[k][4], right[k][5])
                x, y = max(x, y), min(x, y)
                found.append((n, x[0], y[0], x[1], y[1]))
        if nearest:
            kept: dict[bytes, set[tuple]] = {}
            for pair in sorted(set(found), reverse=True):
                for root in pair[3:]:
                    own = kept.setdefault(root, set())
                    if len(own) < NEAREST:
                        own.add(pair)
            found = sorted(set().union(*kept.values()))
        return found

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (1, 2, 3, 4)], names=["a", "b", "a_root", "b_root"])

    def run(batches):
        held: list[tuple] = []
        for whole in batches:
            for batch in slices(whole):
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if held and held[-1][:3] != row[:3]:
                        if len(held) > 1 and (found := solve(held)):
                            yield batch_of(found)
                        held = []
                    held.append(row)
        if len(held) > 1 and (found := solve(held)):
            yield batch_of(found)

    return run


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) after edges between roots; a node that isn't in roots is its own root."""
    moved = materialize(connected_components(edges), "moved")
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    joined = materialize(known.unionByName(moved.join(roots, "node", "left_anti")), "roots")
    discard(moved, roots)
    return joined


def components(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, root) of all nodes that are linked to another."""
    members = _members(nodes)
    tested = materialize(_stars(members, least), "stars")
    links = _links(docs, tested, least)
    roots = materialize(connected_components(links), "roots")
    discard(links)
    signatures, done = None, [tested, members]
    for nearest in (True, False):
        split = _split(members, roots)
        if split.isEmpty():
            discard(split)
            break
        if signatures is None:
            crowded = materialize(split.select("node").distinct(), "crowded")
            signatures = _values(docs, crowded, signature, "signatures")
            done += [crowded, signatures]
        pairs = materialize(_tiles(split, signatures, least, nearest).join(tested, ["a", "b"], "left_anti"), "pairs")
        links = _links(docs, pairs, least)
        roots = _joined(roots, links.join(pairs, ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        tested = tested.unionByName(pairs.select("a", "b"))
        discard(split, links)
        done.append(pairs)
    discard(*done)
    return roots


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id, representative): the class of every document.

    docs has doc_id and text. representative is the node whose text stands for the class.
    """
    docs = docs.select("doc_id", "text")
    texts = docs.select("doc_id", text_node(F.col("text")).alias("node"), "text").where("node is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = materialize(texts.mapInArrow(_sketches, f"doc_id {kind}, node binary, words int, keys array<bigint>"), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.any_value("words").alias("words"), F.any_value("keys").alias("keys"))
    nodes = materialize(nodes, "nodes")
    roots = components(docs, nodes, least)

    classed = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = classed.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("first"))
    of_node = classed.join(named, "root").select("node", F.col("first.least_id").alias("class_id"), F.col("first.node").alias("representative"))
    of_node = materialize(of_node, "classes")
    discard(nodes, roots)
    of_text = sketched.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", "node", "class_id", "representative")
    none = F.lit(None).cast("binary")
    alone = docs.where("text is null").select("doc_id", none.alias("node"), F.col("doc_id").alias("class_id"), none.alias("representative"))
    return of_text.unionByName(alone)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns; documents with null text all stay.

    The document with the least id of the class stays, one row of it if it is repeated.
    """
    found = classes(docs, least)
    firsts = found.where("node = representative and doc_id <=> class_id").select("doc_id", F.col("node").alias("_om_node")).distinct()
    rows = docs.withColumn("_om_node", text_node(F.col("text")))
    own = firsts.withColumnRenamed("doc_id", "_om_id")
    same = F.col("doc_id").eqNullSafe(F.col("_om_id")) & (F.col("_om_node") == F.col("_om_other"))
    kept = rows.where("_om_node is not null").join(own.withColumnRenamed("_om_node", "_om_other"), same)
    kept = kept.drop("_om_other", "_om_id").dropDuplicates(["doc_id", "_om_node"])
    return kept.select(*docs.columns).unionByName(docs.where("text is null"))
