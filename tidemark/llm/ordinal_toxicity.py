"""Toxicity severity by cumulative-link (proportional-odds) regression over sparse text features.

Grades 0..K share one weight vector; P(grade > k) = sigmoid(score - threshold k) with ordered
thresholds, and the severity is the expected grade, the sum of these probabilities. Features are
whole words and word beginnings of 4 to 7 letters, hashed to 2^20 numbers, with value log(1 + count).

The fit reads a bounded sample of labelled rows, SAMPLE_ROWS in all, drawn by hash of the id with
the same quota for each grade and weighted back to the true shares (executors send feature counts,
not texts). The TOP_FEATURES with the largest difference between toxic and other rows are kept, and
weights and thresholds are trained by Adam on the weighted likelihood with an L2 penalty. Scoring
covers every whole text.

Rows: null text and text without a letter get severity 0 and grade 0. Labels that are null, repeat
(the highest grade counts) or name unknown documents are fine; with no label, or one grade only,
every text gets that grade's number (0 without labels). Repeated documents repeat in the result, and
an id that repeats gives the fit one row (the least); an empty table gives an empty result; only
named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, slices

BUCKETS = 1 << 20
SAMPLE_ROWS = 8_000
TOP_FEATURES = 3_000
PENALTY = 0.3
ROUNDS = 400
#: P(grade > 0) from which a text counts as toxic.
TOXIC = 0.4
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word's features."""
    return (zlib.crc32(f"={word}".encode()) % BUCKETS, *[zlib.crc32(word[:k].encode()) % BUCKETS for k in (4, 5, 6, 7) if len(word) > k])


def features(text: str | None) -> dict[int, int]:
    found: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in word_features(word):
            found[f] += n
    return found


def severity_grade() -> Column:
    """0 not toxic, 1 toxic, 2 toxic in a text that is labelled poor as well; null where toxic is null."""
    toxic = F.col("toxic").cast("int")
    return F.when(toxic == 0, 0).when(toxic.isNotNull(), 1 + F.when(F.col("quality") == 0, 1).otherwise(0)).cast("int")


class Model:
    """Weights by feature number, and ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float | None:
        """The linear score; None for a text without a letter."""
        words = _WORD.findall((text or "").lower())
        if not words:
            return None
        known, counts = self.known, {}
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(f for f in word_features(word) if f in self.weights)
            for f in own:
                counts[f] = counts.get(f, 0) + 1
        return sum(self.weights[f] * np.log1p(n) for f, n in sorted(counts.items()))

    def above(self, score: float | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if score is None:
            return np.zeros(len(self.thresholds))
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def train(grades: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> Model:
    """Fit to sparse rows, each (feature numbers, counts)."""
    levels = int(grades.max(initial=0))
    if not len(grades) or levels == 0 or grades.min() == levels:
        return Model({}, np.full(levels, -40.0))
    toxic = grades > 0
    seen, often = np.zeros((2, BUCKETS)), np.zeros(BUCKETS, np.int32)
    for (feature, _), t, w in zip(rows, toxic.astype(int).tolist(), weight.tolist(), strict=True):
        seen[t][feature] += w  # a row has each feature once
        often[feature] += 1
    mass = [weight[~toxic].sum(), weight[toxic].sum()]
    share = (seen[0] + seen[1]) / sum(mass)
    z = (seen[1] / mass[1] - seen[0] / mass[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12))
    z[often < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:TOP_FEATURES]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = [(place[f][place[f] >= 0], np.log1p(c[place[f] >= 0].astype(float))) for f, c in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in kept])
    column, value = np.concatenate([f for f, _ in kept]), np.concatenate([v for _, v in kept])
    n, line = len(grades), np.arange(len(grades))
    w = np.zeros(len(chosen))
    tail = np.array([weight[grades > k].sum() / weight.sum() for k in range(levels)])
    limits = np.log((1 - tail) / np.maximum(tail, 1e-6))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(limits), np.zeros_like(limits)]
    for step in range(1, ROUNDS + 1):
        score = np.bincount(row, weights=w[column] * value, minlength=n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - limits, -30, 30)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        chance = np.maximum(edges[line, grades] - edges[line, grades + 1], 1e-9)
        slope = edges * (1 - edges)
        by_score = weight * (slope[line, grades] - slope[line, grades + 1]) / chance
        by_limit = np.array([(weight * slope[:, k + 1] / chance * ((grades == k).astype(float) - (grades == k + 1))).sum() for k in range(levels)])
        for own, gradient, at in ((w, np.bincount(column, weights=by_score[row] * value, minlength=len(w)) - PENALTY * w, 0), (limits, by_limit, 2)):
            moments[at] = 0.9 * moments[at] + 0.1 * gradient
            moments[at + 1] = 0.99 * moments[at + 1] + 0.01 * gradient**2
            own += 0.05 * (1 - step / (ROUNDS + 1)) * (moments[at] / (1 - 0.9**step)) / (np.sqrt(moments[at + 1] / (1 - 0.99**step)) + 1e-3)
        limits.sort()
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}, limits)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Model of grade (a column over labels) from a bounded, stratified sample of documents with a label."""
    graded = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r.grade: r.n for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, np.empty(0))
    rate = {g: min(1.0, rows / len(counts) / n) for g, n in counts.items()}
    shares = F.create_map(*[F.lit(x) for g, r in sorted(rate.items()) for x in (g, r)])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = graded.where(place < shares[F.col("grade")] * float(1 << 30))

    def counted(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [sorted(features(t).items()) for t in batch.column(1).to_pylist()]
                numbers = pa.array([np.array([f for f, _ in own], "<u4").tobytes() for own in found], pa.binary())
                counts = pa.array([zlib.compress(np.array([n for _, n in own], "<u4").tobytes(), 1) for own in found], pa.binary())  # mostly ones
                yield pa.RecordBatch.from_arrays([*batch.columns[:1], numbers, counts, batch.column(2)], names=["grade", "features", "counts", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("grade", "text", "doc_id")
    counted_rows = sample.mapInArrow(counted, f"grade int, features binary, counts binary, doc_id {kind}")
    # an id that repeats gives one row, so the sample has no more rows than ids were drawn
    got = counted_rows.groupBy("doc_id").agg(F.min(F.struct("grade", "features", "counts")).alias("row")).select("row.*").toArrow()
    order = sorted(range(got.num_rows), key=lambda k: (got.column(0)[k].as_py(), got.column(1)[k].as_py(), got.column(2)[k].as_py()))
    grades = got.column(0).to_numpy()[order].astype(np.int64)
    sparse = [(np.frombuffer(got.column(1)[k].as_buffer(), "<u4"), np.frombuffer(zlib.decompress(got.column(2)[k].as_buffer()), "<u4")) for k in order]
    weight = np.array([1 / rate[g] for g in grades.tolist()])
    return train(grades, sparse, weight * len(weight) / max(weight.sum(), 1e-9))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, severity, p_toxic, grade, toxic) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = [model.above(model.score(t)) for t in batch.column(1).to_pylist()]
        chance = [float(a[0]) if len(a) else 0.0 for a in above]
        grade = [int(np.argmax(-np.diff(np.concatenate([[1.0], a, [0.0]])))) for a in above]
        columns = [pa.array([float(a.sum()) for a in above], pa.float64()), pa.array(chance, pa.float64()), pa.array(grade, pa.int32()), pa.array([c >= TOXIC for c in chance], pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, "severity", "p_toxic", "grade", "toxic"])

    return docs.select(id_column, text_column).mapInArrow(per_batch(run), f"`{id_column}` {kind}, severity double, p_toxic double, grade int, toxic boolean")
