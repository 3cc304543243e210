"""Text work that SQL lacks, over whole Arrow batches: folding, bag similarity, common runs, canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pandas as pd


def folded(texts: pd.Series) -> pd.Series:
    """NFKC-normalised and case-folded texts; null stays null."""
    return texts.str.normalize("NFKC").str.casefold()


def _numbered(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of both columns' lists, all rows after another, with the row of each word; null lists are empty."""
    lists = [[x if x is not None else [] for x in side] for side in (a, b)]
    flat = [np.concatenate([np.asarray(x, object) for x in side] or [np.empty(0, object)]) for side in lists]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in lists]
    numbers = pd.factorize(np.concatenate(flat))[0] if len(flat[0]) + len(flat[1]) else np.empty(0, np.int64)
    return numbers[: len(flat[0])], rows[0], numbers[len(flat[0]) :], rows[1]


def _bag(numbers: np.ndarray, rows: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (row, word or pair of words), and how often each occurs. A row's keys fill (kinds + 1)^2 numbers."""
    same = rows[1:] == rows[:-1]
    pairs = (numbers[:-1] + 1) * (kinds + 1) + numbers[1:] + 1  # words are 1 to kinds, pairs lie above
    base = rows * (kinds + 1) ** 2
    return np.unique(np.concatenate([base + numbers + 1, (base[1:] + pairs)[same]]), return_counts=True)


def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the counts of words and of neighbouring word pairs, row by row; 0 where one side is empty."""
    x, x_rows, y, y_rows = _numbered(a, b)
    kinds = int(max(x.max(initial=0), y.max(initial=0))) + 1
    (x_keys, x_count), (y_keys, y_count) = _bag(x, x_rows, kinds), _bag(y, y_rows, kinds)
    n = len(a)
    span = (kinds + 1) ** 2
    size = [np.bincount(keys // span, weights=count.astype(float) ** 2, minlength=n) for keys, count in ((x_keys, x_count), (y_keys, y_count))]
    both, at_x, at_y = np.intersect1d(x_keys, y_keys, assume_unique=True, return_indices=True)
    dot = np.bincount(both // span, weights=x_count[at_x].astype(float) * y_count[at_y], minlength=n)
    norm = np.sqrt(size[0] * size[1])
    return pd.Series(np.divide(dot, norm, out=np.zeros(n), where=norm > 0))


def bag(words: list[str]) -> tuple[Counter, float]:
    """Counts of words and of neighbouring pairs, and the sum of their squares."""
    counts = Counter(words)
    counts.update(zip(words, words[1:]))  # noqa: B905
    return counts, float(sum(n * n for n in counts.values()))


def bag_cosine(a: tuple[Counter, float], b: tuple[Counter, float]) -> float:
    """cosine() of two bags."""
    (few, _), (many, _) = sorted((a, b), key=lambda x: len(x[0]))
    norm = math.sqrt(a[1] * b[1])
    return float(sum(n * many[x] for x, n in few.items() if x in many)) / norm if norm > 0 else 0.0


def longest_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest run of words that both lists have: a binary search over lengths, for all rows at once."""
    x, x_rows, y, y_rows = _numbered(a, b)
    n = len(a)
    most = np.minimum(np.bincount(x_rows, minlength=n), np.bincount(y_rows, minlength=n)) if n else np.empty(0, np.int64)
    low, high = np.zeros(n, np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        shared = np.zeros(n, bool)
        for size in np.unique(middle[low < high]).tolist():
            chosen = (low < high) & (middle == size)
            runs = [_runs(side, rows, size, chosen) for side, rows in ((x, x_rows), (y, y_rows))]
            shared[np.array(sorted(runs[0] & runs[1]), object).reshape(-1, 1 + size)[:, 0].astype(np.int64)] = True
        low, high = np.where(shared, middle, low), np.where(shared, high, middle - 1)
    return pd.Series(low.astype(np.int32))


def _runs(numbers: np.ndarray, rows: np.ndarray, size: int, chosen: np.ndarray) -> set[tuple[int, ...]]:
    """(row, words) of all runs of size words in the chosen rows."""
    if len(numbers) < size:
        return set()
    own = np.lib.stride_tricks.sliding_window_view(numbers, size)
    inside = (rows[: len(own)] == rows[size - 1 :]) & chosen[rows[: len(own)]]
    return set(map(tuple, np.column_stack([rows[: len(own)][inside], own[inside]]).tolist()))


def fingerprint(value, ascii_only: bool = False) -> str:
    """sha256 of JSON with sorted keys and no spaces."""
    raw = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False, default=str)
    return hashlib.sha256(raw.encode()).hexdigest()


def fingerprints(rows: pd.Series) -> pd.Series:
    """fingerprint of each JSON text; null stays null."""
    return rows.map(lambda x: fingerprint(json.loads(x)), na_action="ignore")


def strict_json(text: str):
    """Parsed JSON; a repeated key is an error."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate JSON keys")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def repeats_a_key(rows: pd.Series) -> pd.Series:
    """Whether each JSON text has an object with a repeated key; null for what is no JSON."""

    def one(text: str):
        try:
            strict_json(text)
        except json.JSONDecodeError:
            return None
        except ValueError:
            return True
        return False

    return rows.map(one, na_action="ignore")
