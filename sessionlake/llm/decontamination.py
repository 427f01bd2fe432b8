"""Benchmark decontamination by spaced-seed hashing.

Windows of tokens are hashed under fixed masks that ignore some of their
positions. Every WINDOW tokens with NEEDED equal ones agree under some mask at
some place, whichever tokens were substituted; items of fewer tokens have masks
of their own length. Test and training hashes are equi-joined; around each hit,
document and item are compared token by token on the hit's diagonal. Tokens are
words, and single characters in scripts that put no spaces between words.

A passage that many items and many documents share is not compared for each pair
of them. Seeds that the same items hold form a class. A window whose tokens are
all equal verifies a document against its class at once, and further hits of
that class in the document are settled with it. Of the other hits, distinct
surroundings are compared, once for each seed.

Training hashes are first tried against a Bloom bitmap of the test hashes. Its
size is fixed (BLOOM_BITS, 8 MB), whatever the benchmark's size: a full bitmap
lets more training hashes into the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written
from sessionlake.llm.textarrays import chunks, matching_bytes, mix, span_hashes, text_column, words

#: Each compares eight tokens; together they meet every way to substitute two of 13.
MASKS = ("111110111", "1101011111", "110011010111", "11110011011", "110111100011")
#: A diagonal overlaps when WINDOW aligned tokens hold at least NEEDED equal ones.
WINDOW = 13
NEEDED = 11
#: Hits further than this from a run's first one begin another run, so that a run stays short.
RUN = 256
#: Tokens of the document kept on either side of a run of hits, to verify them.
REACH = 64
#: A verified window around a hit begins at most so many tokens before it (WINDOW less the shortest mask).
BEFORE = 4
#: Items of fewer tokens than this must be held verbatim. One that more than COMMON_LEAST documents hold, and more than COMMON_SHARE of all, is common.
VERBATIM = 7
COMMON_LEAST = 20
COMMON_SHARE = 0.001
BLOOM_BITS = 1 << 26

_U = np.uint64
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * _U(2) + _U(1)


def needed(width: int) -> int:
    """Tokens that must be equal of `width` aligned ones: NEEDED of WINDOW in proportion."""
    return -(-width * NEEDED // WINDOW)


def masks(width: int) -> tuple[str, ...]:
    """Masks of an item of `width` tokens (WINDOW for longer ones); some mask avoids any substitutions that an overlap may have.

    Short items may have one substitution at most: each of their three masks ignores every third token.
    """
    if width == WINDOW:
        return MASKS
    if needed(width) == width:
        return ("1" * width,)
    return tuple("".join("0" if i % 3 == k else "1" for i in range(width)) for k in range(3))


def exact_hashes(token: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hash of the whole window of `width` tokens at each `start`."""
    h = np.full(len(start), _U(8 * width + len(masks(width)) + 1))
    for i in range(width):
        h += token[start + i] * _FACTORS[i]
    return mix(h)


def seed_hashes(token: np.ndarray, row: np.ndarray, width: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, hash) of every window that lies in one text, for each mask of `width`."""
    for k, mask in enumerate(masks(width)):
        first, span = mask.index("1"), len(mask.rstrip("0"))
        n = len(token) - span + 1
        if n <= 0:
            continue
        start = np.flatnonzero(row[:n] == row[span - 1 :])
        h = np.full(n, _U(8 * width + k + 1))
        for i in range(first, span):
            if mask[i] == "1":
                h += token[i : i + n] * _FACTORS[i]
        yield start, mix(h[start])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & _U(BLOOM_BITS - 1)).astype(np.int64), ((h >> _U(32)) & _U(BLOOM_BITS - 1)).astype(np.int64)


#: First and last code point of scripts without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Their punctuation, which separates as a space does.
STOPS = ((0x3000, 0x3004), (0x3008, 0x3040), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, bytes) of each character of an unspaced script, and every byte of their punctuation."""
    three, four = np.flatnonzero((data >= 0xE0) & (data < 0xF0)), np.flatnonzero(data >= 0xF0)
    three, four = three[three + 2 < len(data)], four[four + 3 < len(data)]

    def code(at: np.ndarray, n: int) -> np.ndarray:
        out = data[at].astype(np.int64) & (0x0F if n == 3 else 0x07)
        for i in range(1, n):
            out = out << 6 | (data[at + i] & 0x3F)
        return out

    def among(points: np.ndarray, ranges) -> np.ndarray:
        found = np.zeros(len(points), bool)
        for a, b in ranges:
            found |= (points >= a) & (points <= b)
        return found

    c3 = code(three, 3)
    one, two = three[among(c3, UNSPACED)], four[among(code(four, 4), UNSPACED)]
    stops = three[among(c3, STOPS)]
    return np.concatenate((one, two)), np.repeat([3, 4], [len(one), len(two)]), (stops[:, None] + np.arange(3)).ravel()


def _tokens(chunk) -> tuple[np.ndarray, np.ndarray]:
    data = matching_bytes(chunk)
    unspaced, size, stops = _unspaced(chunk.data)
    data[stops] = 32
    w = words(chunk, data)
    if not len(unspaced):
        return span_hashes(data, w.start, w.end), w.row
    # words are cut before and after each character of an unspaced script
    start = np.unique(np.concatenate((w.start, unspaced, unspaced + size)))
    word = np.searchsorted(w.start, start, "right") - 1
    inside = (word >= 0) & (start < w.end[np.maximum(word, 0)])
    start, word = start[inside], word[inside]
    end = w.end[word].copy()
    same = np.flatnonzero(word[1:] == word[:-1])
    end[same] = start[same + 1]
    return span_hashes(data, start, end), w.row[word]


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = []
        for c in chunks(text_column(batch)):
            t, row = _tokens(c)
            cut = np.searchsorted(row, np.arange(len(c) + 1))
            tokens += [t[cut[i] : cut[i + 1]].view(np.int64) for i in range(len(c))]
        yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(tokens, pa.int64())], ["item_id", "tokens"])


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i in range(batch.num_rows):
            t = np.asarray(batch.column(1)[i].values.to_numpy(zero_copy_only=False), np.int64).view(_U)
            width = min(len(t), WINDOW)
            whole = np.arange(len(t) - width + 1)
            for start, h, exact in [(*x, False) for x in seed_hashes(t, np.zeros(len(t), np.int64), width)] + [(whole, exact_hashes(t, whole, width), True)]:
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i].as_py()] * n, ids.type), pa.array(start.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, exact))],
                    ["item_id", "item_pos", "seed", "width", "exact"],
                )


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, seeds) of `benchmark` (item_id, text); a seed is exact if it is of a window's every token.

    Items with the same tokens are one item, under the least item_id; an item
    without tokens is never reported.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    source = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    tokens = source.mapInArrow(_item_batches, f"item_id {kind}, tokens array<bigint>").where(F.size("tokens") > 0)
    items = written(tokens.groupBy("tokens").agg(F.min("item_id").alias("item_id")).select("item_id", "tokens"))
    seeds = items.mapInArrow(_seed_batches, f"item_id {kind}, item_pos int, seed bigint, width int, exact boolean")
    return items, written(seeds.distinct())


def bloom_bitmap(seeds: DataFrame) -> np.ndarray:
    """Bitmap of BLOOM_BITS over the seeds' two bit positions, as bytes.

    Bits are or-ed by word in an aggregate; at most BLOOM_BITS / 64 words
    reach the driver, 8 MB.
    """
    low = F.col("seed").bitwiseAND(F.lit(BLOOM_BITS - 1).cast("long"))
    high = F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(BLOOM_BITS - 1).cast("long"))
    bit = seeds.select(F.explode(F.array(low, high)).alias("p"))
    words_ = bit.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words_.toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint8)


def hit_regions(docs: DataFrame, bitmap: np.ndarray, widths: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """(doc_id, start, tokens, offsets, seeds): runs of hits of each document with their surroundings.

    `widths` are those of the items, WINDOW at most. Hits closer than 2 * REACH tokens share a region of up to RUN tokens and
    REACH more on either side, so that every window around a hit lies in its region.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def among(h: np.ndarray) -> np.ndarray:
            one, two = _bits(h)
            return ((bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)

        for batch in batches:
            ids = batch.column(0)
            for c in chunks(text_column(batch)):
                token, row = _tokens(c)
                found = []
                for width in widths:
                    for k, (start, h) in enumerate(seed_hashes(token, row, width)):
                        hit = among(h)
                        found.append((start[hit], h[hit]))
                        if k == 0:  # where all tokens are equal, each mask's are
                            whole = start[hit]
                            whole = whole[whole + width <= len(token)]
                            whole = whole[row[whole + width - 1] == row[whole]]
                            h = exact_hashes(token, whole, width)
                            hit = among(h)
                            found.append((whole[hit], h[hit]))
                at, seed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, _U))
                if len(at) == 0:
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                new = np.concatenate(([True], (at[1:] - at[:-1] > 2 * REACH) | (row[at[1:]] != row[at[:-1]])))
                along = (at - at[np.flatnonzero(new)[np.cumsum(new) - 1]]) // RUN
                new |= np.concatenate(([False], along[1:] != along[:-1]))
                cuts = np.concatenate((np.flatnonzero(new), [len(at)]))
                rows = {k: [] for k in ("id", "start", "tokens", "offsets", "seeds")}
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    r = row[at[a]]
                    first, last = np.searchsorted(row, [r, r + 1])
                    lo, hi = max(int(first), int(at[a]) - REACH), min(int(last), int(at[b - 1]) + WINDOW + REACH)
                    rows["id"].append(ids[c.first + int(r)].as_py())
                    rows["start"].append(lo - int(first))
                    rows["tokens"].append(token[lo:hi].view(np.int64))
                    rows["offsets"].append((at[a:b] - lo).astype(np.int32))
                    rows["seeds"].append(seed[a:b].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"], ids.type), pa.array(rows["start"], pa.int32()), _list_array(rows["tokens"], pa.int64()), _list_array(rows["offsets"], pa.int32()), _list_array(rows["seeds"], pa.int64())], ["doc_id", "start", "tokens", "offsets", "seeds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(regions, f"doc_id {kind}, start int, tokens array<bigint>, offsets array<int>, seeds array<bigint>")


def seed_classes(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): the class (c1, c2) of every seed, and the items of every class.

    Seeds that the same items hold are of one class; it is named by two xors of
    hashes of their ids, so no list of items is gathered. Items of a class are
    those of its least seed.
    """
    held = seeds.select("seed", "item_id", "width", "exact").distinct()
    name = (F.bit_xor(F.xxhash64("item_id")).alias("c1"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("c2"))
    classes = written(held.groupBy("seed", "width", "exact").agg(*name))
    least = classes.groupBy("c1", "c2").agg(F.min("seed").alias("seed"))
    return classes, written(held.join(least, "seed").select("c1", "c2", "item_id", "width").distinct())


def _surroundings(tokens: str, at: str) -> str:
    """SQL: the tokens that a window around a hit may have, null beyond the text; of shorter items, their own window."""
    return f"transform(sequence(if(width = {WINDOW}, -{BEFORE}, 0), width - 1), i -> try_element_at({tokens}, if({at} + i < 0, cast(null as int), {at} + i + 1)))"


def verified_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(exact, near, members, items): what was verified, before it is told for each item.

    exact: (doc_id, c1, c2, width, common) of documents that hold a whole window
    of the items of a class; near: (doc_id, item_id, matched) of windows with
    substitutions; members: (c1, c2, item_id, width); items: (item_id, tokens).
    """
    items, seeds = benchmark_seeds(benchmark)
    classes, members = seed_classes(seeds)
    widths = tuple(sorted(r.width for r in classes.select("width").distinct().collect()))
    regions = written(hit_regions(docs, bloom_bitmap(seeds), widths).withColumn("region", F.expr("uuid()")))
    at = regions.select("region", "doc_id", F.explode(F.arrays_zip("offsets", "seeds")).alias("h")).select("region", "doc_id", F.col("h.offsets").alias("at"), F.col("h.seeds").alias("seed"))
    hits = written(at.join(classes, "seed"))

    held = hits.where("exact").select("doc_id", "c1", "c2", "width").distinct()
    often = F.greatest(F.lit(COMMON_LEAST).cast("double"), F.lit(COMMON_SHARE) * docs.count())
    common = held.where(F.col("width") < VERBATIM).groupBy("c1", "c2").agg(F.count("*").alias("n")).where(F.col("n") > often).select("c1", "c2", F.lit(True).alias("common"))
    exact = written(held.join(common, ["c1", "c2"], "left").withColumn("common", F.coalesce("common", F.lit(False))))

    known = exact.select(F.col("doc_id").alias("known_id"), F.col("c1").alias("k1"), F.col("c2").alias("k2"))
    open_ = hits.where("not exact").join(known, F.expr("doc_id <=> known_id and c1 = k1 and c2 = k2"), "left_anti").select("region", "doc_id", "at", "seed", "width")
    texts = open_.join(regions.select("region", "tokens"), "region").select("doc_id", "seed", "width", F.expr(_surroundings("tokens", "at")).alias("text_around")).distinct()
    texts = written(texts.withColumn("text_key", F.xxhash64("text_around")))
    places = seeds.join(texts.select("seed").distinct(), "seed", "left_semi").join(items, "item_id")
    places = places.select("item_id", "seed", "width", F.expr(_surroundings("tokens", "item_pos")).alias("item_around")).distinct()
    places = written(places.withColumn("item_key", F.xxhash64("item_around")))
    pairs = texts.select("seed", "width", "text_key", "text_around").distinct().join(places.select("seed", "item_key", "item_around").distinct(), "seed")
    equal = f"zip_with(text_around, item_around, (x, y) -> case when x is null or y is null then -{WINDOW} when x = y then 1 else 0 end)"
    sums = "array_max(transform(sequence(1, size(equal) - width + 1), o -> aggregate(slice(equal, o, width), 0, (s, x) -> s + x)))"
    same = pairs.withColumn("equal", F.expr(equal)).withColumn("matched", F.expr(sums)).where(f"matched >= (width * {NEEDED} + {WINDOW - 1}) div {WINDOW}")
    same = written(same.select("seed", "text_key", "item_key", "matched"))
    near = texts.select("doc_id", "seed", "text_key").distinct().join(same, ["seed", "text_key"]).join(places.select("item_id", "seed", "item_key").distinct(), ["seed", "item_key"])
    return exact, near.select("doc_id", "item_id", "matched"), members, items


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, common) of every verified overlap.

    A pair is verified if some WINDOW aligned tokens (the whole item, if it is
    shorter) hold NEEDED equal ones in proportion; `matched` is the most that any
    such window holds. `common` marks items of fewer than VERBATIM tokens that more
    than COMMON_LEAST documents and COMMON_SHARE of all rows hold. Empty inputs
    give no rows; nulls never match; repeated documents repeat only as the same pair.
    """
    exact, near, members, items = verified_hits(docs, benchmark)
    held = exact.join(members.select("c1", "c2", "item_id"), ["c1", "c2"]).select("doc_id", "item_id", F.col("width").alias("matched"), "common")
    best = held.unionByName(near.withColumn("common", F.lit(False))).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.bool_or("common").alias("common"))
    return best.join(items.select("item_id", F.size("tokens").alias("item_tokens")), "item_id").select("doc_id", "item_id", "matched", "item_tokens", "common")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, matched, items, common_items) for every row of `docs`.

    items are the ids of overlapping benchmark items (least id of equal items),
    ascending; an item is reported once. A common item (see `overlaps`), such as
    a one-word answer, is listed in common_items instead and contaminates
    nothing. Documents without an overlap, empty and null texts among them, have
    contaminated false and empty lists. Rows that repeat a doc_id are one
    document, judged together and each returned; so are the rows without one.
    Other columns are not read.
    """
    found, kind = overlaps(docs, benchmark), benchmark.schema["item_id"].dataType.simpleString()
    own = ~F.col("common")
    found = found.groupBy(F.col("doc_id").alias("found_id")).agg(
        F.count_if(own).alias("n_items"), F.max(F.when(own, F.col("matched"))).alias("matched"), F.array_sort(F.collect_set(F.when(own, F.col("item_id")))).alias("items"), F.array_sort(F.collect_set(F.when(F.col("common"), F.col("item_id")))).alias("common_items")
    )
    none = F.expr(f"cast(array() as array<{kind}>)")
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id",
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("common_items", none).alias("common_items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that overlap no benchmark item but common ones, with all their columns; rows without a doc_id are one document."""
    exact, near, _, _ = verified_hits(docs, benchmark)
    found = exact.where("not common").select(F.col("doc_id").alias("found_id")).union(near.select("doc_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")
