"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot n of the schedule goes to the source whose part of the cumulative weights
holds the n-th golden-ratio point, so that every stretch of the mix has its
sources in proportion. Slots are ranked within their source; rank r takes the
source's r-th block of equal tokens, over its documents in shuffled order, and
starts again after the last block. A source's target ends its last slot.

Ranks within a source and places within its shuffled order are running sums
over all its rows, and sources are ordered among themselves, so all of these
are made in two levels (sums of small groups, then within a group): neither a
source nor the table of sources is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: Words of a block. Which words are taken does not depend on it, only how finely the mix alternates; a very large corpus may want larger ones.
BLOCK = 64
#: Rows of a small group of the two-level sums, about.
GROUP = 256
#: Slots that one task draws, about.
TASK_SLOTS = 1 << 22
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
GOLDEN = 0.6180339887498949


def sizes(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """`df` with nth (from 1, in `order`) and, for each column c of `sums`, c_before: its sum over the rows before.

    Rows are dealt to tasks by ranges of `order`; what the tasks before hold is
    one row for each task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("part").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums])
    per = per.select("part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("rows", *sums)])
    here = {f"{c}_here": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    both = dealt.withColumns({"nth_here": F.row_number().over(inside), **here}).join(F.broadcast(per), "part")
    return both.select(*df.columns, (F.col("nth_here") + F.col("rows_ahead")).alias("nth"), *[(F.col(f"{c}_here") + F.col(f"{c}_ahead")).alias(f"{c}_before") for c in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) per source of `sized` (source, size).

    Weights go round the sources by code point, null last. Targets share
    `share` of all sizes by weight; none exceeds MOST_REPEATS times its source's
    size, and the excess is shared again by weight until none is above. Sorted
    by cap per weight, the sources at their cap come first, so that two running
    sums over the table of sources give the result. Ties are broken by source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * MOST_REPEATS).cast("double")
    ranked = running(totals, [name], []).select("source", "source_size", weight.alias("weight"), cap.alias("cap"), (cap / weight).alias("ratio"))
    levelled = written(running(ranked, [F.col("ratio"), name], ["cap", "weight"]))
    every = levelled.agg(F.sum("cap"), F.sum("weight")).first()
    level = (F.lit(every[0] or 0.0) * (share / MOST_REPEATS) - F.col("cap_before")) / (F.lit(every[1] or 1.0) - F.col("weight_before"))
    # the first source that stays under its cap at its level: those before it are at their caps
    water = levelled.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", "nth")).first()[0]
    return levelled.select("source", "source_size", F.least("cap", F.lit(float("inf") if water is None else water) * F.col("weight")).alias("target"))


def placed_documents(rows: DataFrame) -> DataFrame:
    """`rows` (row, shuffle, source_id, size) with `place`: words before the row in its source's shuffled order."""
    count = rows.count()
    groups = max(1, count // GROUP)
    grouped = rows.withColumn("g", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * groups / (1 << 32)).cast("long"))
    sums = written(grouped.groupBy("source_id", "g").agg(F.sum("size").alias("words")))
    # the second level again in two steps: sums of runs of groups, then groups within a run
    run = F.floor(F.col("g") / GROUP)
    runs = sums.groupBy("source_id", run.alias("run")).agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_id", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("source_id", "run").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("run", run).withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
    starts = starts.join(runs, ["source_id", "run"]).select("source_id", "g", (F.col("run_start") + F.col("inner")).alias("group_start"))
    here = Window.partitionBy("source_id", "g").orderBy("shuffle", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.withColumn("inner", F.coalesce(F.sum("size").over(here), F.lit(0)))
    return inner.join(starts, ["source_id", "g"]).withColumn("place", F.col("group_start") + F.col("inner")).drop("g", "inner", "group_start")


def schedule(spark, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_id, rank, block): the mix in order, as blocks of sources.

    `targets` has source_id, source_size and target (a table of sources). A
    source weighs what it needs in slots: every lap has a short last block of
    its own. Slots beyond a source's need are left out, the schedule is a little
    longer than all needs, and what a source still lacks after the drawn slots
    follows them, so that every source reaches its target.
    """
    lap = F.ceil(F.col("source_size") / block)
    end = F.round("target").cast("long")
    rest = F.pmod(end, F.col("source_size"))
    needs = targets.where("target > 0 and source_size > 0").select("source_id", "source_size", lap.alias("blocks"), (F.floor(end / F.col("source_size")) * lap + F.ceil(rest / block)).alias("need"))
    needs = needs.where("need > 0")
    total = needs.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    n = int(total * 1.02) + 64 if total else 0
    parts = written(running(needs, [F.col("source_id")], ["need"])).select(
        "source_id", "blocks", "need",
        (F.col("need_before") / F.lit(total or 1)).alias("low"),
        ((F.col("need_before") + F.col("need")) / F.lit(total or 1)).alias("high"),
        F.col("nth").alias("number"),
    )
    # the cumulative weights are cut into cells, so that a slot meets its source by equality
    sources = max(1, parts.count())
    cells = sources * 4
    by_cell = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK_SLOTS)
    points = spark.range(0, n, 1, tasks).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(GOLDEN) % 1.0).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    drawn = points.join(F.broadcast(by_cell) if cells <= 4 * BROADCAST_SOURCES else by_cell, "cell").where("point >= low and point < high")
    drawn = drawn.select("slot", "source_id", "blocks", "need", F.floor(F.col("slot") / GROUP).alias("g"))
    counts = written(drawn.groupBy("source_id", "g").agg(F.count("*").alias("k")))
    run = F.floor(F.col("g") / GROUP)
    runs = counts.groupBy("source_id", run.alias("run")).agg(F.sum("k").alias("k"))
    runs = runs.select("source_id", "run", F.coalesce(F.sum("k").over(Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_start"))
    starts = counts.withColumn("run", run)
    starts = starts.withColumn("inner", F.coalesce(F.sum("k").over(Window.partitionBy("source_id", "run").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(runs, ["source_id", "run"]).select("source_id", "g", (F.col("run_start") + F.col("inner")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source_id", "g").orderBy("slot")) - 1
    ranked = drawn.withColumn("inner", rank).join(starts, ["source_id", "g"]).withColumn("rank", F.col("start") + F.col("inner"))
    ranked = ranked.where("rank < need").select("slot", "source_id", "rank", "blocks")
    have = counts.groupBy("source_id").agg(F.sum("k").alias("have"))
    lacking = parts.join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < need")
    lacking = lacking.select("source_id", "blocks", "number", "have", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    added = lacking.select((F.lit(n) + (F.col("rank") - F.col("have")) * sources + F.col("number")).cast("long").alias("slot"), "source_id", "rank", "blocks")
    return ranked.unionByName(added).select("slot", "source_id", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("lap"))


def mixed_pieces(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    rows: (row, doc_id, size, source_size, target) for every row of `docs`
    (doc_id, text, source). pieces: (slot, row, from_word, words), the part of
    a row that a slot takes; the mix is the pieces by slot, then place.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"), F.xxhash64("text").alias("t"))
    shuffle = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("t").cast("string"))))
    sized = written(sized.select("doc_id", "source", "size", shuffle.alias("shuffle"), "t").withColumn("row", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("t").cast("string"), F.expr("uuid()"))))
    targets = written(source_targets(sized).withColumn("source_id", F.xxhash64("source", F.col("source").isNull())))
    n = targets.count()
    near = F.broadcast(targets) if n <= BROADCAST_SOURCES else targets
    rows = sized.withColumn("source_id", F.xxhash64("source", F.col("source").isNull())).join(near.drop("source"), "source_id")
    # rows without words have no place in the order
    placed = placed_documents(rows.where("size > 0"))
    placed = written(placed.unionByName(rows.where("size <= 0").withColumn("place", F.lit(0).cast("long")).select(placed.columns)))
    first, last = F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").select("row", "source_id", "source_size", "target", "place", "size", F.explode(F.sequence(first, last)).alias("block"))
    slots = schedule(spark, targets, block)
    low, high = F.greatest(F.col("place"), F.col("block") * block), F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block)
    met = cut.join(slots, ["source_id", "block"])
    end = F.round("target").cast("long") - F.col("lap") * F.col("source_size")  # where the target ends in this lap
    words = F.greatest(F.least(high, end) - low, F.lit(0))
    pieces = met.select("slot", "row", (low - F.col("place")).alias("from_word"), words.alias("words")).where("words > 0")
    return placed.select("row", "doc_id", "size", "source_size", "target"), pieces


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs` (doc_id, text, source).

    taken: words that the mix takes of the row, repeats counted; never above
    MOST_REPEATS times its size, and the same for every `block`. The order of
    documents within a source is by md5 of doc_id, so reruns agree. Null texts
    have size 0 and are never taken; null sources are one source; equal doc_ids
    are ordered by text hash, rows without one by it alone, and each of repeated
    rows is returned. Other columns are not read. Empty tables give empty results.
    """
    rows, pieces = mixed_pieces(docs, block)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
