"""Language identification by compression.

A language's model is a zstandard raw-content dictionary: snippets of its labelled texts. A text is
lowered, cut into blocks (so that the dictionary counts all along a long text) and every block is
compressed with each dictionary; the language with the smallest sum is chosen. The score is the
margin, 1 - smallest / second smallest, in 0..1; predictions with a margin under MIN_MARGIN are
marked as rejected.

The fit reads a bounded sample of labelled rows: DICTIONARY_BYTES a language, in snippets of
SNIPPET characters, chosen by hash of the row so that neither order nor partitioning matters.
Languages are counted over all rows first. Prediction uses whole texts.

Rows: null text and text without a letter give `und`, score 0, not rejected. With no labelled row
every row gives `und`. With one language the score is 1. Equal sizes go to the language that is
first by name. Null ids are never learned from. Repeated rows repeat; only the id, text and label
columns are read, so others don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch

DICTIONARY_BYTES = 128 << 10
SNIPPET = 500
BLOCK = 8192
LEVEL = 6
MIN_MARGIN = 0.01
_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, label: str = "lang", text_column: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary of each label, from a bounded sample of the rows with label and text."""
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text_column).alias("body")).where("label is not null and body is not null and body rlike '\\\\p{L}'")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = max(8, 2 * dictionary_bytes // SNIPPET)
    share = F.create_map(*[F.lit(x) for label_, n in sorted(counts.items()) for x in (label_, min(1.0, want / n))]) if counts else None
    found: dict[str, list] = {label_: [] for label_ in counts}
    if share is not None:
        place = F.pmod(F.xxhash64("label", "body"), F.lit(1 << 30))
        at = F.pmod(F.xxhash64("body", F.lit(1)), F.greatest(F.length("body") - SNIPPET, F.lit(1))).cast("int") + 1
        sample = rows.where(place < share[F.col("label")] * float(1 << 30)).select("label", F.lower(F.substring("body", at, F.lit(SNIPPET))).alias("snippet"), place.alias("place"))
        for r in sample.dropDuplicates(["label", "snippet"]).collect():  # about want texts a label
            found[r.label].append((r.place, r.snippet))
    for label_, own in found.items():
        if not own:  # many copies of few texts, none of them drawn
            own += [(0, r.snippet) for r in rows.where(F.col("label") == label_).select(F.lower(F.substring("body", 1, SNIPPET)).alias("snippet")).distinct().orderBy("snippet").limit(8).collect()]
    return {label_: "\n".join(s for _, s in sorted(own)).encode()[:dictionary_bytes] for label_, own in sorted(found.items())}


class Classifier:
    def __init__(self, models: dict[str, bytes]):
        self.labels = sorted(models)
        self.coders = []
        for label in self.labels:
            content = zstandard.ZstdCompressionDict(models[label].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(label, score, rejected)"""
        if text is None or not self.labels or not _LETTER.search(text):
            return "und", 0.0, False
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(coder.compress(b)) for b in blocks), label) for coder, label in zip(self.coders, self.labels, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        score = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], score, score < MIN_MARGIN


_OWN: dict[bytes, Classifier] = {}


def _classifier(models: dict[str, bytes]) -> Classifier:
    key = hashlib.sha256(repr(sorted(models.items())).encode()).digest()
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Classifier(models)
    return _OWN[key]


def predict(docs: DataFrame, models: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    run = _predictor(models, id_column)
    return docs.select(id_column, text_column).mapInArrow(per_batch(run), f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")


def _predictor(models: dict[str, bytes], id_column: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _classifier(models)
        rows = [own(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, "lang_pred", "score", "rejected"])

    return run


def fold(id_column: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3))
