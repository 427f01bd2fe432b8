"""SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at `radius` or fewer differing bits share a value at half the
radius or less from both. So every distinct fingerprint emits all variants in
its ball of half the radius, variants meet in a shuffle, and those that share
one are linked; two fingerprints that share a variant are always within the
radius, by the triangle inequality, and the link is verified all the same.

Shipping 2,081 variants per fingerprint would move kilobytes for each. A
variant's bucket is therefore a linear code of it: bit c of the bucket is the
parity of the variant's bits i with i mod classes = c. Flipping one or two bits
reaches 1 + classes + classes*(classes-1)/2 buckets, so a fingerprint is sent
once to each of those, and the bucket's task makes the variants that fall into
it. Near copies differ in several parities, so that even a group with a third
of all fingerprints spreads over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.components import connected_components
from sessionlake.llm.scratch import written
from sessionlake.llm.textarrays import LOWER, Chunk, chunks, text_column, words

SEED = 42
SHINGLE = 4
RADIUS = 4


def chunk_fingerprints(chunk: Chunk, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text of a chunk."""
    n = len(chunk)
    out = np.zeros(n, np.uint64)
    w = words(chunk)
    if len(w.start) == 0:
        return out
    # Texts with single spaces between words, so that a shingle is one byte range.
    length = w.end - w.start
    to = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=to[1:])
    flat = np.full(int(to[-1]), 32, np.uint8)
    shift = np.repeat(to[:-1] - w.start, length)
    source = np.arange(int(length.sum())) + np.repeat(w.start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    flat[source + shift] = LOWER[chunk.data[source]]
    text, begin, end = flat.tobytes(), to[:-1], to[:-1] + length
    count = np.bincount(w.row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    full = np.flatnonzero(w.row[: len(w.row) - shingle + 1] == w.row[shingle - 1 :]) if len(w.row) >= shingle else np.zeros(0, np.int64)
    rows = w.row[full]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(begin[full].tolist(), end[full + shingle - 1].tolist(), strict=True)), np.uint64, len(full))
    votes = np.zeros((n, 64), np.int32)
    for lo in range(0, len(rows), 1 << 16):  # bounded unpacked bits
        r = rows[lo : lo + (1 << 16)]
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.concatenate(([True], r[1:] != r[:-1]))
        place = np.arange(len(r)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        at = np.flatnonzero(place % 255 == 0)  # eight byte counters in a word hold 255 rows
        sums = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).astype(np.int32)
        again = np.flatnonzero(np.concatenate(([True], r[at][1:] != r[at][:-1])))
        votes[r[at[again]]] += np.add.reduceat(sums, again, axis=0)
    total = np.maximum(count - shingle + 1, 0)
    if len(rows):
        on = votes * 2 > total[:, None]
        out[:] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
        out[total == 0] = 0
    for i in np.flatnonzero((count > 0) & (count < shingle)):
        out[i] = digest(text[begin[first[i]] : end[first[i + 1] - 1]], SEED)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [chunk_fingerprints(c) for c in chunks(text_column(batch))]
        fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of `docs` (doc_id, text); fp is the fingerprint as a signed long.

    Whole texts; A-Z lower-cased; shingles of four words with repeats; fewer
    words make one shingle, none (or a null text) the fingerprint zero.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bucket_classes(n: int) -> int:
    """Parity classes so that a bucket gets about 50,000 fingerprints or fewer."""
    c = 6
    while c < 24 and n * (1 + c + c * (c - 1) // 2) >> c > 50_000:
        c += 1
    return c


def _class_masks(classes: int) -> list[int]:
    return [sum(1 << i for i in range(c, 64, classes)) for c in range(classes)]


def _reached(classes: int) -> list[int]:
    """Bucket differences that a ball of half the radius (two flips) reaches."""
    return [0, *(1 << c for c in range(classes)), *((1 << c) | (1 << d) for c, d in combinations(range(classes), 2))]


def _flips(classes: int) -> dict[int, np.ndarray]:
    """For each bucket difference, the flips of up to two bits that make it."""
    out: dict[int, list[int]] = {d: [] for d in _reached(classes)}
    out[0].append(0)
    for i in range(64):
        out[1 << (i % classes)].append(1 << i)
    for i, j in combinations(range(64), 2):
        out[(1 << (i % classes)) ^ (1 << (j % classes))].append((1 << i) | (1 << j))
    return {d: np.array(v, np.uint64) for d, v in out.items()}


def _spanning_links(fp: np.ndarray, rep: np.ndarray, diff: np.ndarray, flips: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `rep` that join all fingerprints which share a variant in this bucket."""
    variants, owner = [], []
    for d in np.unique(diff):
        at, f = np.flatnonzero(diff == d), flips[int(d)]
        variants.append((fp[at][:, None] ^ f[None, :]).ravel())
        owner.append(np.repeat(at.astype(np.int32), len(f)))
    value = np.concatenate(variants)
    ordered = np.sort(value)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice) == 0:
        return rep[:0], rep[:0]
    twice = np.unique(twice)
    at = np.searchsorted(twice, value)
    at[at == len(twice)] = 0
    hit = twice[at] == value
    value, owner = value[hit], np.concatenate(owner)[hit]
    order = np.lexsort((rep[owner], value))
    value, owner = value[order], owner[order]
    head = np.concatenate(([True], value[1:] != value[:-1]))
    lead = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
    other = owner[~head]
    lead = lead[~head]
    near = np.bitwise_count(fp[lead] ^ fp[other]) <= RADIUS
    code = np.unique(lead[near].astype(np.int64) * len(fp) + other[near])
    one, two = code // len(fp), code % len(fp)
    label = np.arange(len(fp))  # local components, so that a bucket emits a forest
    by_rep = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
    label = by_rep.copy()
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        if np.array_equal(new, label):
            break
        label = new
    back = np.empty_like(by_rep)
    back[by_rep] = np.arange(len(fp))
    moved = np.flatnonzero(label != by_rep)
    return rep[back[label[moved]]], rep[moved]


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect the reps of all `distinct` (fp, rep) within the radius."""
    classes = bucket_classes(n)
    code = F.lit(0).cast("long")
    for c, mask in enumerate(_class_masks(classes)):
        signed = mask - (1 << 64) if mask >> 63 else mask
        code = code + (F.bit_count(F.col("fp").bitwiseAND(F.lit(signed).cast("long"))) % 2).cast("long") * F.lit(1 << c).cast("long")
    sent = distinct.select("fp", "rep", code.alias("code"), F.explode(F.array(*[F.lit(d).cast("long") for d in _reached(classes)])).alias("diff"))
    sent = sent.select("fp", "rep", F.col("diff").cast("int").alias("diff"), F.col("code").bitwiseXOR(F.col("diff")).alias("bucket"))
    flips = _flips(classes)

    def links(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            a = b = np.zeros(0, np.int64)
        else:
            columns = {c: table.column(c).to_numpy() for c in ("fp", "rep", "diff")}
            a, b = _spanning_links(columns["fp"].view(np.uint64), columns["rep"], columns["diff"], flips)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("bucket").applyInArrow(links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs` (doc_id long, text); see the module text.

    component_id is the least doc_id of the connected component of fingerprints
    at RADIUS or fewer bits. Equal fingerprints (exact copies among them) are
    merged by an aggregate before anything else. An empty table gives an empty
    result; repeated rows repeat; extra columns are ignored; a null doc_id
    keeps its row, with a null component unless its fingerprint has another.
    """
    fps = written(fingerprints(docs))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = written(near_links(distinct.where("rep is not null"), distinct.count()).distinct())
    parts = connected_components(links)
    label = distinct.join(parts, distinct.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs` (doc_id, text, ...), with all its columns: that with the least doc_id.

    Rows without a doc_id come after all others; of rows alike in doc_id and
    text one stays. Rows are told apart by a hash of both. An empty table gives
    an empty result.
    """
    # the whole row travels as one column, so that no name of its own can clash
    key = F.xxhash64(docs["doc_id"], docs["doc_id"].isNull(), docs["text"], docs["text"].isNull())
    rows = docs.select(key.alias("key"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    parts = simhash_components(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    parts = parts.groupBy("key").agg(F.any_value("component_id").alias("component_id"))
    copies = rows.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    found = written(copies.join(parts, "key"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("first")).select("first.key")
    gone = found.join(first, "key", "left_anti").select("key")
    repeated = found.where("copies > 1").select("key")
    left = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(gone, "key", "left_anti")
    once = left.join(repeated, "key", "left_anti").unionByName(left.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return once.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def hex_fingerprint(fp: Column) -> Column:
    """A signed long fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
