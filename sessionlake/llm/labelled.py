"""Labelled rows and held-out folds shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds` (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label value, the same ones on every run.

    Labels are counted, then a row stays if a hash of its key falls under its
    label's share; nothing is sorted and no label's rows meet in one task. The
    number of label values must be small (languages, 0/1 marks).
    """
    counts = rows.groupBy(label).count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(per_label / r["count"])).otherwise(share)
    point = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(point < share)


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one 0/1 label per document; of contradicting rows the larger."""
    y = F.when(F.col(column) > 0, 1).otherwise(0)
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(y).alias("y"))


def training_texts(docs: DataFrame, labels: DataFrame, column: str, folds: int, out: int, per_label: int) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of labelled documents outside fold `out`.

    The sample is drawn from the labels, so its size is bounded (two labels of
    about per_label rows) before it is joined to the texts.
    """
    known = labels_of(labels, column).where(fold(F.col("doc_id"), folds) != out)
    chosen = bounded_sample(known, "y", "doc_id", per_label)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
