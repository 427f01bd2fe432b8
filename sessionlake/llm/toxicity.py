"""Toxicity: a counterfactual-regularised linear classifier.

Logistic regression over the presence of hashed words and word beginnings,
sparse by an L1 penalty. Each training text that names a group (IDENTITY) is
paired with the same text with another group's name, and the squared change of
its score is penalised, so that a neutral mention of a group does not move it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.labelled import training_texts
from sessionlake.llm.textarrays import Chunk, SpanHasher, chunks, matching_bytes, text_column, words

BITS = 18
#: Training texts per label, at most about.
PER_LABEL = 3000
#: Bytes of a word's beginning that are features besides the whole word.
BEGINNINGS = (4, 5, 6)
#: Group names that are swapped for one another, by kind, in the corpus's languages (English, German, Spanish, French). No word is in two groups.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "gehörlose", "blinde", "senioren"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "sordos", "ciegos", "ancianos"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "sourds", "aveugles", "vieillards"),
)
TERMS = [t for group in IDENTITY for t in group]


def chunk_tokens(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each word, and its features: whole word and beginnings (-1 if it is no longer)."""
    data = matching_bytes(chunk)
    w = words(chunk, data)
    hashed = SpanHasher(data)
    shift = np.uint64(64 - BITS)
    out = [(hashed(w.start, w.end) >> shift).astype(np.int64)]
    for k in BEGINNINGS:
        f = (hashed(w.start, np.minimum(w.start + k, w.end)) * np.uint64(2 * k + 1) >> shift).astype(np.int64)
        f[w.end - w.start <= k] = -1
        out.append(f)
    return w.row, out


def term_features(term: str) -> np.ndarray:
    _, f = chunk_tokens(next(chunks(pa.array([term]))))
    return np.unique([int(x[0]) for x in f if x[0] >= 0])


def _present(row: np.ndarray, features: list[np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, of features that `wanted` marks."""
    codes = []
    for f in features:
        own = f >= 0 if wanted is None else (f >= 0) & wanted[f]
        codes.append(row[own].astype(np.int64) << BITS | f[own])
    code = np.unique(np.concatenate(codes))
    return code >> BITS, code & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    features: np.ndarray  # with a weight other than zero
    weights: np.ndarray
    bias: float


def train(texts: list[np.ndarray], y: np.ndarray, terms: list[list[int]], share: float, l1: float = 2e-3, cost: float = 5.0, rounds: int = 300) -> ToxicityModel:
    """Fit by accelerated proximal gradient.

    texts: distinct features of each text; terms: the identity terms it names;
    share: the part of label 1 among all labelled rows, to which the bias is set.
    """
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    size = 1 << BITS
    n1, n0 = y.sum(), (1 - y).sum()
    flat, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    a, b = np.bincount(flat, y[row], size), np.bincount(flat, 1 - y[row], size)
    pooled = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((a + b >= 2) & (np.abs(z) > 2.0))
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    own = place[flat] >= 0
    idx, row = place[flat[own]], row[own]
    swaps = []  # each: places that leave, places that come
    by_term = [place[term_features(t)] for t in TERMS]
    for named in terms:
        for t in named:
            group = next(g for g in IDENTITY if TERMS[t] in g)
            other = TERMS.index(group[(group.index(TERMS[t]) + 1) % len(group)])
            swaps.append((by_term[t], by_term[other]))
    d_idx = np.array([i for out, into in swaps for i in (*out, *into)], int)
    d_row = np.array([k for k, (out, into) in enumerate(swaps) for _ in (*out, *into)], int)
    d_sign = np.array([s for out, into in swaps for s in (*(-1.0 for _ in out), *(1.0 for _ in into))])
    d_idx, d_row, d_sign = d_idx[d_idx >= 0], d_row[d_idx >= 0], d_sign[d_idx >= 0]
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    per_text = np.bincount(row, minlength=len(y)).max(initial=1)
    step = 1 / (0.25 * (per_text + 1) * 1.0 + 2 * cost * 64 * (len(swaps) > 0))
    step *= 4  # with backtracking below
    w = v = np.zeros(len(kept) + 1)

    def value(u: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.bincount(row, u[idx], len(y)) + u[-1]
        p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        loss = (weight * (np.logaddexp(0, m) - y * m)).sum()
        r = weight * (p - y)
        g = np.append(np.bincount(idx, r[row], len(kept)), r.sum())
        if len(d_idx):
            change = np.bincount(d_row, d_sign * u[d_idx], len(swaps))
            loss += cost * (change**2).mean()
            g[:-1] += np.bincount(d_idx, 2 * cost / len(swaps) * change[d_row] * d_sign, len(kept))
        return loss, g

    for t in range(rounds):
        loss, g = value(v)
        while True:
            new = v - step * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * l1)
            moved = new - v
            if value(new)[0] <= loss + g @ moved + (moved @ moved) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        v, w = new + t / (t + 3) * (new - w), new
    bias = w[-1] + np.log(max(share, 1e-6) / max(1 - share, 1e-6)) * 0.5
    some = np.flatnonzero(w[:-1])
    return ToxicityModel(kept[some], w[some], float(bias))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, per_label: int = PER_LABEL) -> ToxicityModel:
    """Train on a bounded sample of labelled rows outside fold `out`."""
    sample = training_texts(docs, labels, "toxic", folds, out, per_label)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = {int(chunk_tokens(next(chunks(pa.array([t]))))[1][0][0]): k for k, t in enumerate(TERMS)}
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("y"))
            for c in chunks(text_column(batch)):
                row, f = chunk_tokens(c)
                if len(row) == 0:
                    r = x = np.zeros(0, np.int64)
                else:
                    r, x = _present(row, f)
                cut = np.searchsorted(r, np.arange(len(c) + 1)).astype(np.int32)
                whole = [set(f[0][row == i].tolist()) & named.keys() for i in range(len(c))]
                terms = pa.array([sorted(named[v] for v in s) for s in whole], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([y.slice(c.first, len(c)), pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))), terms], ["y", "x", "terms"])

    table = sample.select("text", "y").mapInArrow(features, "y int, x array<int>, terms array<int>").toArrow()
    texts = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64) for v in table.column("x")] if table.num_rows else []
    y, terms = np.array(table.column("y").to_pylist(), float), table.column("terms").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], texts[i].tobytes()))
    from sessionlake.llm.labelled import fold, labels_of

    known = labels_of(labels, "toxic").where(fold(F.col("doc_id"), folds) != out).agg(F.avg("y")).first()[0]
    return train([texts[i] for i in order], y[order], [terms[i] for i in order], float(known or 0.0))


def score_chunk(chunk: Chunk, model: ToxicityModel, weight: np.ndarray) -> np.ndarray:
    total = np.full(len(chunk), model.bias)
    row, f = chunk_tokens(chunk)
    if len(row):
        r, x = _present(row, f, weight != 0)
        total += np.bincount(r, weight[x], len(chunk))
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text); null and empty texts get the bias alone.

    Whole texts. With no labelled rows the score is the same for every text. A
    row's score depends on its text alone: repeated rows are each returned,
    with equal scores; null doc_ids stay null. Other columns are not read. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight = np.zeros(1 << BITS)
        weight[m.features] = m.weights
        for batch in batches:
            parts = [score_chunk(c, m, weight) for c in chunks(text_column(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
