"""Language identification by hierarchical discrimination.

A document's language family is predicted first; one-versus-one linear support
vector machines then separate the languages within the family. Features are
hashed frequencies of byte pairs, triples and quadruples of the lower-cased
text, so a machine's value is one table lookup per position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.labelled import bounded_sample, fold
from sessionlake.llm.textarrays import LOWER, Chunk, chunks, text_column

DIMENSIONS = 2048
#: Training texts per language at most about; a machine's examples are bounded by this.
PER_LANGUAGE = 500
#: A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_U = np.uint32
_STEPS = (_U(0x01000193), _U(0x85EBCA6B), _U(0xC2B2AE35))


def _grams(chunk: Chunk) -> Iterator[np.ndarray]:
    """Feature of the pair, triple and quadruple at each byte (DIMENSIONS where it would leave the text)."""
    data = LOWER[chunk.data].astype(_U)
    n = len(data)
    left = np.repeat(chunk.starts[1:], np.diff(chunk.starts)) - np.arange(n)
    h = data * _STEPS[0]
    for size in (2, 3, 4):
        shifted = np.zeros(n, _U)
        shifted[: n - size + 1] = data[size - 1 :]
        h = (h ^ shifted) * _STEPS[size - 2]
        h ^= h >> _U(15)
        out = ((h * _U(0x9E3779B1)) >> _U(32 - 11)).astype(np.int32)
        out[left < size] = DIMENSIONS
        yield out


def _sums(values: np.ndarray, chunk: Chunk) -> np.ndarray:
    out = np.zeros(len(chunk))
    some = np.flatnonzero(np.diff(chunk.starts) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, chunk.starts[some])
    return out


def chunk_features(chunk: Chunk) -> np.ndarray:
    """Gram frequencies of each text, as rows of DIMENSIONS numbers that sum to 1 (0 if it has no gram)."""
    n = len(chunk)
    row = np.repeat(np.arange(n), np.diff(chunk.starts))
    counts = np.zeros(n * (DIMENSIONS + 1))
    for g in _grams(chunk):
        counts += np.bincount(row * (DIMENSIONS + 1) + g, minlength=len(counts))
    counts = counts.reshape(n, -1)[:, :-1]
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights and, last, bias of a linear SVM (squared hinge, balanced classes) for y in {-1, 1}."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * (weight[:, None] * z * z).sum() + penalty)
    step = max(step, 1 / (2 * np.linalg.norm(np.sqrt(weight)[:, None] * z, 2) ** 2 + penalty))
    w = v = np.zeros(z.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (penalty * v - 2 * z.T @ (weight * y * slack))
        v, w = new + t / (t + 3) * (new - w), new
    out = np.append(w[:-1] / spread, 0.0)
    out[-1] = w[-1] - (w[:-1] / spread) @ mean
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]  # language indices
    family_pairs: list[tuple[int, int]]
    language_pairs: list[tuple[int, int]]
    weights: np.ndarray  # a row per machine, family pairs first; bias last


def train(x: np.ndarray, y: list[str]) -> LanguageModel:
    """Fit all machines; with one language or none there is nothing to separate."""
    languages = sorted(set(y))
    names = sorted({FAMILY_OF.get(v, v) for v in languages})
    families = [[i for i, v in enumerate(languages) if FAMILY_OF.get(v, v) == f] for f in names]
    label = np.array([languages.index(v) for v in y], int)
    family = np.array([next(k for k, f in enumerate(families) if v in f) for v in label], int)
    family_pairs = list(combinations(range(len(families)), 2))
    language_pairs = [p for f in families for p in combinations(f, 2)]
    rows = []
    for target, pairs in ((family, family_pairs), (label, language_pairs)):
        for a, b in pairs:
            own = (target == a) | (target == b)
            rows.append(train_machine(x[own], np.where(target[own] == a, 1.0, -1.0)))
    return LanguageModel(languages, families, family_pairs, language_pairs, np.array(rows).reshape(len(rows), DIMENSIONS + 1))


def _margins(chunk: Chunk, model: LanguageModel) -> np.ndarray:
    grams = list(_grams(chunk))
    n = sum(_sums((g < DIMENSIONS).astype(float), chunk) for g in grams)
    out = np.empty((len(chunk), len(model.weights)))
    for k, w in enumerate(model.weights):
        table = np.append(w[:-1], 0.0)
        out[:, k] = sum(_sums(table[g], chunk) for g in grams) / np.maximum(n, 1) + w[-1]
    return out


def _winner(n: int, members: list[int], pairs: list[tuple[int, int]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member with most pairwise wins (ties: larger sum of margins), and its chance."""
    votes = np.zeros((n, len(members)))
    soft = np.full((n, len(members)), 1.0)
    place = {m: k for k, m in enumerate(members)}
    for k, (a, b) in enumerate(pairs):
        p = 1 / (1 + np.exp(-4 * np.clip(margins[:, k], -50, 50)))
        votes[:, place[a]] += (p >= 0.5) + 1e-3 * p
        votes[:, place[b]] += (p < 0.5) + 1e-3 * (1 - p)
        soft[:, place[a]] = np.minimum(soft[:, place[a]], p)
        soft[:, place[b]] = np.minimum(soft[:, place[b]], 1 - p)
    best = votes.argmax(axis=1)
    return best, soft[np.arange(n), best]


def predict_chunk(chunk: Chunk, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score of each text."""
    n, margins = len(chunk), _margins(chunk, model)
    first = len(model.family_pairs)
    family, sure = _winner(n, list(range(len(model.families))), model.family_pairs, margins[:, :first])
    lang, score = np.zeros(n, int), sure.copy()
    for k, members in enumerate(model.families):
        own = np.flatnonzero(family == k)
        cols = [i for i, p in enumerate(model.language_pairs) if p[0] in members]
        best, chance = _winner(len(own), members, [model.language_pairs[i] for i in cols], margins[np.ix_(own, [first + i for i in cols])])
        lang[own] = np.array(members)[best]
        score[own] *= chance
    return lang, score


def fit(docs: DataFrame, folds: int = 3, out: int = 1, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on a bounded sample of rows with a text and a lang outside fold `out`."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("doc_id"), folds), F.lit(0)) != out))
    sample = bounded_sample(own.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "lang", "doc_id", per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(text_column(batch)):
                x = chunk_features(c).astype(np.float32)
                at = pa.array(np.arange(len(c) + 1, dtype=np.int32) * DIMENSIONS)
                lang = batch.column(batch.schema.get_field_index("lang")).slice(c.first, len(c))
                yield pa.RecordBatch.from_arrays([lang, pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["lang", "x"])

    table = sample.select("text", "lang").mapInArrow(features, "lang string, x array<float>").toArrow()
    x = table.column("x").combine_chunks().values.to_numpy().reshape(-1, DIMENSIONS).astype(float) if table.num_rows else np.zeros((0, DIMENSIONS))
    y = table.column("lang").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))  # the same model however rows arrive
    return train(x[order], [y[i] for i in order])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text).

    `und` with score 0 if the text is null or has no letter, or if nothing was
    learned. Whole texts; other columns are ignored. A prediction depends on the
    text alone: repeated rows are each returned, alike; null doc_ids stay null;
    ties between languages go to the first by name. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            letter = batch.column(batch.schema.get_field_index("letter")).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                for c in chunks(text_column(batch)):
                    lang[c.first : c.first + len(c)], score[c.first : c.first + len(c)] = predict_chunk(c, m)
            lang[~letter], score[~letter] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[lang], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
