"""Token counts of a document's sections from one encoding of the whole document.

The whole text is encoded once. Token lengths give byte offsets, and those, by the text's lead
bytes, half-open character spans; a token that holds part of a character spans it. Sections are
character spans that tile the text. The interval join of both is a binary search over the
sections' starts. A token that crosses a boundary is allocated by one of three rules:

- start: to the section of its first character;
- majority: to the section that has most of its characters, of equals the first;
- split: to each section by its share of the characters.

Each rule's counts add up to the document's token count.

Rows: null and empty text have no section and no row. Repeated documents repeat. Very long texts
are encoded as a whole. An empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import per_batch


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        end = np.cumsum(self.size[ids])
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(lead) - 1  # of each byte
        return character[end - self.size[ids]], character[end - 1] + 1


_TITLE = re.compile(r"[^\n.!?]*[.!?]+[ \t]+")


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def line_kind(line: str) -> str:
    if not line.strip():
        return "blank"
    if "|" in line:
        return "table"
    return "list" if line.lstrip()[:2] in ("- ", "* ") else "prose"


def sections(text: str) -> list[tuple[str, int]]:
    """(kind, first character): the title, then runs of lines of one kind.

    The title is the first line's first sentence with the white space after it; a line owns its newline.
    """
    out: list[tuple[str, int]] = []
    title = _TITLE.match(text)
    at = title.end() if title else 0
    if at:
        out.append(("title", 0))
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        kind = line_kind(text[at:end])
        if not out or out[-1][0] != kind:
            out.append((kind, at))
        at = end
    return out


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Counts of each section, by rule, of tokens with spans [first, last); sections tile [0, size)."""
    n = len(starts)
    edges = np.append(starts, size)
    head = np.searchsorted(starts, first, "right") - 1
    tail = np.searchsorted(starts, last - 1, "right") - 1
    out = {"start": np.bincount(head, minlength=n), "crossing": np.bincount(head[head != tail], minlength=n)}
    majority, split = head.copy(), np.bincount(head[head == tail], minlength=n).astype(float)
    for t in np.flatnonzero(head != tail).tolist():
        own = np.arange(head[t], tail[t] + 1)
        share = np.minimum(edges[own + 1], last[t]) - np.maximum(edges[own], first[t])
        majority[t] = own[share.argmax()]
        split[own] += share / share.sum()
    return out | {"majority": np.bincount(majority, minlength=n), "split": split}


def attribute(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text", cut=sections) -> DataFrame:
    """(id, section, kind, first_char, last_char, n_tokens by start, n_majority, n_split, n_crossing) of every section.

    cut gives the sections of a text; another function can name a record's fields.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    fields = [("section", pa.int32()), ("kind", pa.string()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("n_tokens", pa.int64()), ("n_majority", pa.int64()), ("n_split", pa.float64()), ("n_crossing", pa.int64())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _encoder(rank_file, pattern)
        row, columns = [], [[] for _ in fields]
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            found = cut(text)
            starts = np.array([s for _, s in found], np.int64)
            counts = allocate(*own.spans(text), starts, len(text))
            row += [k] * len(found)
            ends = [*starts[1:].tolist(), len(text)]
            values = (range(len(found)), [name for name, _ in found], starts.tolist(), ends, counts["start"].tolist(), counts["majority"].tolist(), counts["split"].tolist(), counts["crossing"].tolist())
            for column, value in zip(columns, values, strict=True):
                column.extend(value)
        ids = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]], names=[id_column, *[n for n, _ in fields]])

    schema = f"`{id_column}` {kind}, section int, kind string, first_char long, last_char long, n_tokens long, n_majority long, n_split double, n_crossing long"
    return docs.select(id_column, text_column).mapInArrow(per_batch(run), schema)
