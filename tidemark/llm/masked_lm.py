"""Document scores by masked pseudo-likelihood.

Words are hashed to 2^20 numbers, which fall into CLASSES classes by corpus frequency: the most
frequent have a class each, the others share classes of equal mass in order of frequency. A window
network sees the classes of the two words to the left and the two to the right (a mark beyond the
text's ends), adds an embedding for each place and class, applies tanh, and gives a softmax over the
class of the masked word in the middle. A word's conditional probability is its class's, times the
word's share of its class in the corpus. The sum of its logarithm over all words is the document's
score.

Counts come from all documents. Training is data-parallel over all documents too, each in one of
ROUNDS rounds by the text's hash and in one shard of about SHARD_WORDS words by a hash of id and
text: a shard's windows are gone over in order of that hash, by gradient descent in numpy from the
round's common parameters, and the shards' parameters are averaged by their words in a group-by. So
the parameters don't depend on how the table is partitioned. Only classes, a byte a word, are
shuffled to the shards. The driver holds only the counts (2^20 numbers) and the parameters.

Rows: null text and text without words have no words and score 0; their mean is null. One word is
predicted from the marks alone. Repeated documents repeat and count again in training. An empty table
gives an empty result; only named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

BUCKETS = 1 << 20
CLASSES = 64
#: Classes that hold one word each.
SINGLE = 40
WIDTH = 16
REACH = 2
ROUNDS = 2
RATE = 0.5
BATCH = 1024
SLICE = 1 << 20
#: Words of a shard, and of what a shard holds at once.
SHARD_WORDS, HELD_WORDS = 1 << 19, 1 << 16
REMEMBERED = 500_000


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return found


_NUMBERS = _Numbers()


def numbers(text: str | None) -> np.ndarray:
    """Hashed numbers of a text's words (lowered, between white space)."""
    words = (text or "").lower().split()
    if len(_NUMBERS) > REMEMBERED:
        _NUMBERS.clear()
    return np.array([_NUMBERS[w] for w in words], np.int64)


class Vocabulary:
    """Class of each word number, and the logarithm of its share of the class."""

    def __init__(self, counts: np.ndarray):
        self.words = int(counts.sum())
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order[SINGLE:]]).astype(float)
        shared = CLASSES - SINGLE
        rest = np.minimum((mass / max(mass[-1], 1) * shared * (1 - 1e-12)).astype(np.int64), shared - 1)
        self.of = np.empty(BUCKETS, np.int64)
        self.of[order[:SINGLE]] = np.arange(SINGLE)
        self.of[order[SINGLE:]] = SINGLE + rest
        smooth = counts + 0.5
        total = np.bincount(self.of, weights=smooth, minlength=CLASSES)
        self.share = np.log(smooth / total[self.of]).astype(np.float32)
        self.mass = np.log(np.maximum(total, 0.5) / total.sum()).astype(np.float32)


class Network:
    def __init__(self, parameters: np.ndarray | None = None):
        shapes = ((2 * REACH, CLASSES + 1, WIDTH), (WIDTH, CLASSES), (CLASSES,))
        if parameters is None:
            rng = np.random.default_rng(7)
            parameters = np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) for s in shapes[:2]] + [np.zeros(CLASSES)])
        parts, at = [], 0
        for shape in shapes:
            n = int(np.prod(shape))
            parts.append(parameters[at : at + n].reshape(shape).astype(np.float32))
            at += n
        self.embed, self.out, self.bias = parts

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.out.ravel(), self.bias]).astype(np.float64)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of the classes, from rows of 2 * REACH context classes."""
        hidden = self.embed[0][context[:, 0]]
        for k in range(1, 2 * REACH):
            hidden += self.embed[k][context[:, k]]
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.out
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return hidden, logits

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        hidden, delta = self.forward(context)
        np.exp(delta, out=delta)
        delta[np.arange(len(target)), target] -= 1
        delta *= np.float32(rate / len(target))
        back = (delta @ self.out.T) * (1 - hidden * hidden)
        self.out -= hidden.T @ delta
        self.bias -= delta.sum(axis=0)
        for k in range(2 * REACH):
            order = np.argsort(context[:, k], kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(context[order, k]) > 0]))
            self.embed[k][context[order[first], k]] -= np.add.reduceat(back[order], first, axis=0) * np.float32(CLASSES / 4)


def windows(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Context rows and targets of texts given as classes of words."""
    mark = np.full(REACH, CLASSES, np.int64)
    joined = np.concatenate([x for own in classes for x in (own, mark)] or [mark])
    padded = np.concatenate([mark, joined])
    at = np.flatnonzero(joined != CLASSES)
    places = [at + k for k in range(2 * REACH + 1) if k != REACH]
    return np.stack([padded[p] for p in places], axis=1), joined[at]


def count(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Corpus count of every word number."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, SLICE):
                own = [numbers(t) for t in batch.column(0).to_pylist()]
                total += np.bincount(np.concatenate(own) if own else [], minlength=BUCKETS)
        found = np.flatnonzero(total)
        for start in range(0, len(found), 1 << 16):
            part = found[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["word", "n"])

    got = docs.select(text_column).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return out


def _round_of(text: str) -> int:
    return zlib.crc32(text.encode()) % ROUNDS


def train(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Averaged parameters after ROUNDS rounds over all documents."""
    start = Network()
    start.bias = vocabulary.mass  # the context's part is learnt from there
    parameters = start.parameters()
    shards = -(-vocabulary.words // (ROUNDS * SHARD_WORDS)) or 1
    place = F.xxhash64(id_column, text_column)
    texts = docs.select(place.alias("place"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), text_column).where(F.col(text_column).isNotNull())
    for step in range(ROUNDS):
        classed = texts.mapInArrow(_classed(vocabulary, step), "shard int, place long, classes binary")
        dealt = classed.repartition("shard").sortWithinPartitions("shard", "place", "classes")
        rows = dealt.mapInArrow(_trainer(parameters, step), "shard int, at int, n long, x double")
        got = rows.groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toArrow()
        parameters[got.column("at").to_numpy()] = got.column("x").to_numpy()
    return parameters


def _classed(vocabulary: Vocabulary, step: int):
    """Maps (place, shard, text) of the round's texts to their classes, a byte each."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                texts = batch.column(2).to_pylist()
                chosen = [k for k, t in enumerate(texts) if _round_of(t) == step]
                classes = pa.array([vocabulary.of[numbers(texts[k])].astype(np.uint8).tobytes() for k in chosen], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(chosen, pa.int32())), batch.column(0).take(pa.array(chosen, pa.int32())), classes], names=["shard", "place", "classes"])

    return run


def _trainer(parameters: np.ndarray, step: int):
    """Maps whole shards, in order, to the parameters that each learns."""

    def learn(network: Network, held: list[np.ndarray]) -> int:
        context, target = windows(held)
        mixed = np.random.default_rng(len(target)).permutation(len(target))
        for start in range(0, len(target), BATCH):
            own = mixed[start : start + BATCH]
            network.learn(context[own], target[own], RATE / (1 + step) * len(own) / BATCH)
        return len(target)

    def learnt(shard: int, network: Network, seen: int) -> pa.RecordBatch:
        found = network.parameters()
        columns = [np.full(len(found), shard, np.int32), np.arange(len(found), dtype=np.int32), np.full(len(found), seen, np.int64), found]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "at", "n", "x"])

    def run(batches):
        shard, network, seen, held, size = None, None, 0, [], 0
        for batch in batches:
            for own, classes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != shard:
                    seen += learn(network, held) if held else 0
                    if seen:
                        yield learnt(shard, network, seen)
                    shard, network, seen, held, size = own, Network(parameters), 0, [], 0
                held.append(np.frombuffer(classes, np.uint8).astype(np.int64))
                size += len(classes)
                if size >= HELD_WORDS:
                    seen += learn(network, held)
                    held, size = [], 0
        seen += learn(network, held) if held else 0
        if seen:
            yield learnt(shard, network, seen)

    return run


def score(docs: DataFrame, vocabulary: Vocabulary, parameters: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        network = Network(parameters)
        for whole in batches:
            for batch in slices(whole, SLICE):
                own = [numbers(t) for t in batch.column(1).to_pylist()]
                size = np.array([len(x) for x in own], np.int64)
                context, target = windows([vocabulary.of[x] for x in own])
                words = np.concatenate(own) if own else np.empty(0, np.int64)
                each = np.empty(len(target))
                for start in range(0, len(target), 4 * BATCH):
                    part = slice(start, start + 4 * BATCH)
                    _, logs = network.forward(context[part])
                    each[part] = logs[np.arange(len(logs)), target[part]] + vocabulary.share[words[part]]
                total = np.bincount(np.repeat(np.arange(len(own)), size), weights=each, minlength=len(own)).astype(float)  # whole numbers where there is no word
                mean = pa.array(np.where(size > 0, total / np.maximum(size, 1), 0.0), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total), mean], names=[id_column, "n_tokens", "log_prob", "mean_log_prob"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, log_prob double, mean_log_prob double")


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Count, train and score the same documents."""
    vocabulary = Vocabulary(count(docs))
    return score(docs, vocabulary, train(docs, vocabulary))
