"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made for whole Arrow batches with array operations; trees are
grown over binned statistics and flattened into arrays, so that prediction is
a few gathers per tree level for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.labelled import training_texts
from sessionlake.llm.textarrays import LOWER, Chunk, SpanHasher, chunks, mix, text_column, words

STATISTICS = (
    "words", "bytes", "word_bytes", "distinct_words", "top_word", "repeats_last", "upper", "digits", "symbols", "exclamations",
    "stops", "commas", "bars", "lines", "line_words", "dup_lines", "ended_lines", "dup_windows", "non_ascii", "short_words", "mixed_words",
)
#: Training texts per label, at most about.
PER_LABEL = 5000
WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>{}[]=+~^_\\/@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _runs(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct values, and the count of the most frequent."""
    if len(row) == 0:
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    size = np.diff(np.append(head, len(r)))
    most = np.zeros(n)
    np.maximum.at(most, r[head], size)
    return np.bincount(r[head], minlength=n).astype(float), most


def chunk_statistics(chunk: Chunk) -> np.ndarray:
    """A row of STATISTICS for each text; all zero for an empty text."""
    n, data = len(chunk), chunk.data
    size = np.diff(chunk.starts).astype(float)
    byte_row = np.repeat(np.arange(n), np.diff(chunk.starts))

    def share(flag: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(byte_row[flag], minlength=n) / np.maximum(of, 1)

    w = words(chunk)
    count = np.bincount(w.row, minlength=n).astype(float)
    lowered = LOWER[data]
    hashed = SpanHasher(lowered)
    token = hashed(w.start, w.end)
    distinct, most = _runs(w.row, token, n)
    again = (w.row[1:] == w.row[:-1]) & (token[1:] == token[:-1])
    length = w.end - w.start
    short = np.bincount(w.row, length <= 3, n) / np.maximum(count, 1)
    inner_upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=inner_upper[1:])
    caps = inner_upper[w.end] - inner_upper[np.minimum(w.start + 1, w.end)]
    line = words(chunk, separators=~_NEWLINE)
    line_hash = hashed(line.start, line.end)
    lines = np.bincount(line.row, minlength=n).astype(float)
    distinct_lines, _ = _runs(line.row, line_hash, n)
    ended = np.isin(data[line.end - 1], np.frombuffer(b".!?", np.uint8)) if len(line.end) else np.zeros(0, bool)
    m = max(0, len(token) - WINDOW + 1)
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + token[k : k + m]
    full = w.row[:m] == w.row[WINDOW - 1 :] if m else np.zeros(0, bool)
    windows, _ = _runs(w.row[:m][full], mix(h[full]), n)
    total = np.bincount(w.row[:m][full], minlength=n)
    out = np.column_stack([
        np.log1p(count), np.log1p(size), np.bincount(w.row, length, n) / np.maximum(count, 1), distinct / np.maximum(count, 1), most / np.maximum(count, 1),
        np.bincount(w.row[1:][again], minlength=n) / np.maximum(count, 1), share(_UPPER[data], size), share(_DIGIT[data], size), share(_SYMBOLS[data], size), share(data == 33, count),
        share(data == 46, count), share(data == 44, count), share(data == 124, count), np.log1p(lines), count / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(lines, 1), np.bincount(line.row, ended, n) / np.maximum(lines, 1),
        1 - windows / np.maximum(total, 1), share(data >= 128, size), short, np.bincount(w.row, caps > 0, n) / np.maximum(count, 1),
    ])
    out[count == 0] = 0
    return out


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0) -> Trees:
    """Grow boosted trees on logistic loss from histograms of binned statistics."""
    n1 = float(np.sum(y))
    p = (n1 + 1) / (len(y) + 2)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    roots: list[int] = []
    if len(y) and 0 < n1 < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        margin = np.full(len(y), np.log(p / (1 - p)))
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            root = node(0.0)
            roots.append(root)
            todo = [(root, np.arange(len(y)), 0)]
            while todo:
                at, rows, level = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes["value"][at] = -rate * gs / (hs + l2)
                best = (1e-3, -1, -1)
                if level < depth and len(rows) >= 2 * least:
                    for f, e in enumerate(edges):
                        if len(e) == 0:
                            continue
                        b = binned[rows, f]
                        gl, hl, cl = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(cl < least) | (len(rows) - cl < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                _, f, k = best
                if f < 0:
                    margin[rows] += nodes["value"][at]
                    continue
                goes = binned[rows, f] <= k
                nodes["feature"][at], nodes["threshold"][at] = f, float(edges[f][k])
                nodes["left"][at], nodes["right"][at] = node(0.0), node(0.0)
                todo += [(nodes["left"][at], rows[goes], level + 1), (nodes["right"][at], rows[~goes], level + 1)]
    return Trees(np.array(roots, int), *(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), float(np.log(p / (1 - p))), depth)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, per_label: int = PER_LABEL) -> Trees:
    """Train on a bounded sample of labelled rows outside fold `out`."""
    sample = training_texts(docs, labels, "quality", folds, out, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(text_column(batch)):
                x = chunk_statistics(c)
                at = pa.array(np.arange(len(c) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")).slice(c.first, len(c)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["y", "x"])

    table = sample.select("text", "y").mapInArrow(run, "y int, x array<double>").toArrow()
    x = table.column("x").combine_chunks().values.to_numpy().reshape(-1, len(STATISTICS)) if table.num_rows else np.zeros((0, len(STATISTICS)))
    y = np.array(table.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text), 1 for good quality.

    Whole texts; null and empty texts have all statistics zero. With no
    labelled rows every score is 0.5. A score depends on the text alone:
    repeated rows are each returned, alike; null doc_ids stay null. Other
    columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [1 / (1 + np.exp(-m.margin(chunk_statistics(c)))) for c in chunks(text_column(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_accepted(docs: DataFrame, model: Trees, accept: float) -> DataFrame:
    """Rows of `docs` whose score is `accept` or more, with all their columns; scored where they are, without a shuffle. Rows alike are judged alike; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [1 / (1 + np.exp(-m.margin(chunk_statistics(c)))) for c in chunks(text_column(batch))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= accept))

    return docs.mapInArrow(run, docs.schema)
