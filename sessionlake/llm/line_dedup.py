"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is repeated if an earlier line (by doc_id, then place) has the same
normalised text or is within EDITS edits of it. A line is split into EDITS + 1
segments, whose size depends on the class of its length. Of two strings within
EDITS edits, the segments of the shorter hold one, the i-th say, that is whole
in the longer with exactly i edits before it: the first one at the beginning,
the last one at the end, one between at a shift of at most i. So each distinct
line is indexed under its segments and probes, for the classes of the lengths
that it can match, its substrings at those shifts.

Few lines share a key. Where more than CROWD do (a family of lines with a
common beginning, say), the key alone would make all their pairs: there the
parities of the counts of letters and of pairs of letters are compared too. An
edit changes two of 64 letter parities at most, so of BLOCKS blocks of them all
but 2 * EDITS stay equal: crowded lines meet only on their key with two whole
blocks. Candidates are verified with a banded bit-parallel edit distance.

Lines with equal normalised text are merged by an aggregate before the join, so
that copies never multiply. Equal lines are told by two independent 64-bit
hashes; the edit join carries the first of them and verifies on the texts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.components import connected_components
from sessionlake.llm.scratch import written

EDITS = 2
#: Lines of fewer normalised characters are left out of the edit join; exact repeats of them are told apart and kept by default.
LEAST_CHARS = 24
#: Index entries of a key beyond which it is crowded.
CROWD = 4
#: Blocks of parities: 2 * EDITS of them can differ, two are in a crowded key.
BLOCKS = 2 * EDITS + 2
#: Rows up to which a table of keys or places is broadcast (24 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 500_000
#: A text is hot if it is more than one of this many lines; so there are fewer hot texts than this, and they are broadcast.
HOT_SHARE = 10_000
HOT_LEAST = 1_000

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def normalised(text: Column) -> Column:
    """Lower-cased, digits as 0, white space other than newlines as one space."""
    spaced = F.regexp_replace(text, r"[\x09\x0B-\x0D]+|\x20{2,}", " ")
    # most texts have none, and looking for it is much cheaper than replacing it
    odd = F.contains(text, F.lit("  ")) | text.rlike(r"[\x09\x0B-\x0D]")
    return F.regexp_replace(F.lower(F.when(odd, spaced).otherwise(text)), "[1-9]", "0")


def _raw_lines(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))


def numbered_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line_no, norm, length, h1, h2) of every line of `least` normalised characters or more; line_no from 0."""
    lines = _raw_lines(docs, normalised(F.col("text").cast("string"))).select("doc_id", "line_no", F.trim("raw").alias("norm"))
    lines = lines.withColumn("length", F.char_length("norm")).where(F.col("length") >= least)
    return lines.select("doc_id", "line_no", "norm", "length", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("line"), "norm").alias("h2"))


def class_start(length: Column) -> Column:
    """The least length of a length's class; classes are wider than EDITS."""
    return length - length % F.when(length < 192, 8).otherwise(32)


def segment_keys(norm: Column, length: Column, start: Column, edits: int = EDITS) -> tuple[list[Column], list[Column]]:
    """Keys of a line in the class of lengths from `start`: of its segments, and of its substrings at the shifts of the segments between."""
    size = F.floor(start / (edits + 1)).cast("int")

    def key(i: int, at: Column) -> Column:
        return F.xxhash64(start, F.lit(i), F.substring(norm, at, size))

    own = [key(i, size * i + 1) for i in range(edits)] + [key(edits, length - size + 1)]
    return own, [key(i, size * i + 1 + shift) for i in range(1, edits) for shift in range(-i, i + 1) if shift]


def letter_counts(norm: Column) -> Column:
    """Parities of the counts of code points, by code point modulo 64, as the bits of one long."""
    return F.aggregate(F.split(norm, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(_bit(F.ascii(c))))


def counts_apart(a: str, b: str) -> Column:
    """How many parities of two letter_counts differ; at most twice the edit distance."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def signatures(norm: DataFrame) -> DataFrame:
    """`norm` (.., norm) with counts (letter_counts) and p0, p1: parities of the counts of 128 classes of letter pairs, the last letter and nothing among them."""
    letters = norm.withColumn("letters", F.split("norm", ""))
    twos = F.transform("letters", lambda c, i: F.xxhash64(c, F.get("letters", i + 1)).bitwiseAND(F.lit(127).cast("long")).cast("int"))
    none = F.lit(0).cast("long")
    both = F.aggregate(twos, F.struct(none.alias("a"), none.alias("b")), lambda s, t: F.struct(F.when(t < 64, s["a"].bitwiseXOR(_bit(t))).otherwise(s["a"]).alias("a"), F.when(t < 64, s["b"]).otherwise(s["b"].bitwiseXOR(_bit(t))).alias("b")))
    return letters.withColumn("counts", letter_counts(F.col("norm"))).withColumn("p", both).select(*norm.columns, "counts", F.col("p.a").alias("p0"), F.col("p.b").alias("p1"))


def may_be_near(x: str = "x", y: str = "y", edits: int = EDITS) -> Column:
    """Whether the signatures of two texts, in columns with these prefixes, allow `edits` edits: an edit changes two letter parities and four of pairs at most."""
    return (counts_apart(f"{x}_counts", f"{y}_counts") <= 2 * edits) & (counts_apart(f"{x}_p0", f"{y}_p0") + counts_apart(f"{x}_p1", f"{y}_p1") <= 4 * edits)


def parity_blocks(counts: Column, blocks: int = BLOCKS) -> list[Column]:
    """For every two of the `blocks` blocks of a letter_counts, a number that tells which two and what they hold."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(ends)]
    both = [masks[i] | masks[j] for i, j in itertools.combinations(range(blocks), 2)]
    return [F.xxhash64(F.lit(n), counts.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for n, m in enumerate(both)]


def place(docs: DataFrame) -> Column:
    """A line's place (doc_id, line_no), in one value that orders by doc_id, then line: a number where doc_id is one, which aggregates by hash."""
    if dict(docs.dtypes)["doc_id"] in _INTEGRAL:
        return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line_no").cast("decimal(11,0)")
    return F.struct("doc_id", "line_no")


def _place_parts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """`places` with doc_id and line_no read back from its column place."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in _INTEGRAL:
        return places.withColumn("doc_id", F.col("place.doc_id")).withColumn("line_no", F.col("place.line_no"))
    low = F.pmod("place", F.lit(1 << 32))
    return places.withColumn("doc_id", ((F.col("place") - low) / (1 << 32)).cast(kind)).withColumn("line_no", low.cast("int"))


def edit_distance(a: str, b: str, edits: int = EDITS) -> Column:
    """Banded bit-parallel edit distance of columns `a` (no longer) and `b`; over `edits` it is only some larger number.

    The 2 * edits + 1 cells of a column around the diagonal are bits of a
    number; vertical and horizontal differences move to the next column by a
    few bit operations. Both strings are cut to what remains without their
    common beginning and end, and padded in front so that the band fits.
    """
    k, width = edits, 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    first = (full >> (width - k - 1)) << (width - k - 1)
    pad = "array(" + ", ".join(["''"] * k) + ")"

    def common(x: str, y: str) -> str:
        return f"coalesce(nullif(array_position(zip_with({x}, {y}, (p, q) -> p <=> q), false), 0) - 1, least(size({x}), size({y})))"

    equal = " | ".join(f"if(get(v.a, s.i + {d}) = c, {1 << (d + k)}, 0)" for d in range(-k, k + 1))
    # transform(array(value), name -> ...)[0] gives a value a name
    return F.expr(f"""
      transform(array(named_struct('x', split({a}, ''), 'y', split({b}, ''))), w ->
       transform(array(cast({common("w.x", "w.y")} as int)), p ->
        transform(array(named_struct('x', slice(w.x, p + 1, size(w.x) - p), 'y', slice(w.y, p + 1, size(w.y) - p))), r ->
         transform(array(cast({common("reverse(r.x)", "reverse(r.y)")} as int)), q ->
          transform(array(named_struct('a', concat({pad}, slice(r.x, 1, size(r.x) - q)), 'b', concat({pad}, slice(r.y, 1, size(r.y) - q)))), v ->
           aggregate(v.b, named_struct('i', 0, 'vp', {first}, 'vn', 0, 'd', {k}, 'h', {top >> 1}), (s, c) ->
            transform(array({equal}), e ->
             transform(array(((((s.vp & e) + s.vp) ^ s.vp) | e | s.vn) & {full}), d0 ->
              transform(array(named_struct('hp', (s.vn | ~(d0 | s.vp)) & {full}, 'hn', d0 & s.vp)), h ->
               named_struct(
                'i', s.i + 1,
                'vp', (h.hn | ~(shiftright(d0, 1) | h.hp)) & {full},
                'vn', shiftright(d0, 1) & h.hp,
                'd', s.d + if(s.i < size(v.a) - {k}, if((d0 & {top}) = 0, 1, 0), if((h.hp & s.h) <> 0, 1, 0) - if((h.hn & s.h) <> 0, 1, 0)),
                'h', if(s.i < size(v.a) - {k}, s.h, shiftright(s.h, 1))))[0])[0])[0],
            s -> s.d))[0])[0])[0])[0])[0]""")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _texts_of(source: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, norm) and signatures of the texts in `wanted` (h1), each read once, at its first place."""
    places = written(_place_parts(texts.join(wanted, "h1").select("h1", "place"), source).select("h1", "doc_id", "line_no"))
    n = places.count()
    holders = _small(places.select("doc_id").distinct(), n)
    raw = _raw_lines(source.join(holders, "doc_id", "left_semi"), F.col("text").cast("string")).join(_small(places, n), ["doc_id", "line_no"])
    norm = raw.select("h1", F.trim(normalised(F.col("raw"))).alias("norm")).where(F.xxhash64("norm") == F.col("h1")).dropDuplicates(["h1"])
    return written(signatures(norm))


def _candidates(source: DataFrame, texts: DataFrame, own: list[str], other: list[str]) -> DataFrame:
    """(a, b): hashes of texts that share a key and may be within EDITS edits, each pair once.

    A row of the join has a key, a text's hash and its length, negative unless
    the text is indexed under the key. The shorter text of a pair is the
    indexed one.
    """
    signed = [F.struct(F.col(k).alias("key"), F.col("length").alias("size")) for k in own] + [F.struct(F.col(k).alias("key"), (-F.col("length")).alias("size")) for k in other]
    rows = texts.select("h1", F.inline(F.array(*signed))).where(F.col("key").isNotNull())
    crowded = written(rows.where("size > 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"))
    n = crowded.count()

    def met(rows: DataFrame, signed: bool = False) -> DataFrame:
        x, y = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "xy")
        on = F.col("x_key") == F.col("y_key")
        longer = F.abs("y_size") - F.col("x_size")
        on = on & ((longer.between(1, EDITS)) | ((longer == 0) & (F.col("x_h1") < F.col("y_h1"))))
        if signed:
            on = on & may_be_near()
        return x.join(y, on).select(F.least("x_h1", "y_h1").alias("a"), F.greatest("x_h1", "y_h1").alias("b")).where("a <> b")

    if not n:
        return written(met(rows).distinct())
    many = rows.join(_small(crowded, n), "key", "left_semi")
    read = _texts_of(source, texts, many.select("h1").distinct()).drop("norm")
    finer = many.join(read, "h1").select("h1", "size", "counts", "p0", "p1", F.explode(F.array(*[F.xxhash64("key", part) for part in parity_blocks(F.col("counts"))])).alias("key"))
    few = rows.join(_small(crowded, n), "key", "left_anti")
    return written(met(few).unionByName(met(finer, True)).distinct())


def line_verdicts(docs: DataFrame, classes: bool = True, short: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines, links).

    lines: (doc_id, line_no, h1, short, first, near, n_links, linked_class) for
    every line of LEAST_CHARS or more, and with `short` for every shorter line
    with a character too (short is true, and there are no links): `first` marks the first of its normalised text,
    `near` that an earlier different text is within EDITS; n_links counts the
    different texts within EDITS; linked_class is the least hash of the texts
    that links join to it, null without links (or without `classes`). links:
    (a, b) pairs of those texts' hashes, each once.
    """
    source = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    norm, length = F.col("norm"), F.col("length")
    own, shifted = segment_keys(norm, length, class_start(length))
    # a line in the lowest places of its class may match a shorter one of the class below
    below = class_start(length - EDITS)
    lower = [F.when((below < class_start(length)) & (below >= class_start(F.lit(LEAST_CHARS))), k) for ks in segment_keys(norm, length, below) for k in ks]
    keys = {f"k{i}": F.when(length >= LEAST_CHARS, k) for i, k in enumerate([*own, *shifted, *lower])}
    # keys are plain columns, all equal within a text, so that a hash aggregate merges copies without sorting
    keyed = numbered_lines(source, 1 if short else LEAST_CHARS).select("doc_id", "line_no", "h1", "h2", "length", *[k.alias(name) for name, k in keys.items()])
    keyed = written(keyed)
    at = place(keyed)
    long = keyed.where(F.col("length") >= LEAST_CHARS)
    texts = written(long.groupBy("h1", "h2").agg(F.min(at).alias("place"), F.count("*").alias("n"), F.max("length").alias("length"), *[F.max(k).alias(k) for k in keys]))
    names = list(keys)
    pairs = _candidates(source, texts, names[: len(own)], names[len(own) :])
    found = _texts_of(source, texts, pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    x, y = (found.select(*[F.col(c).alias(f"{side}_{c}") for c in found.columns]) for side in "xy")
    sides = pairs.join(x, F.col("a") == F.col("x_h1")).join(y, F.col("b") == F.col("y_h1")).where(may_be_near())
    shorter = F.char_length("x_norm") <= F.char_length("y_norm")
    sides = sides.select("a", "b", F.when(shorter, F.col("x_norm")).otherwise(F.col("y_norm")).alias("x"), F.when(shorter, F.col("y_norm")).otherwise(F.col("x_norm")).alias("y"))
    links = written(sides.where(edit_distance("x", "y") <= EDITS).select("a", "b"))
    seen = texts.select("h1", "h2", F.col("place").alias("at"), "n")
    linked = links.select(F.explode(F.array("a", "b")).alias("h1")).distinct().join(seen.select("h1", "at"), "h1")
    ends = links.join(linked.select(F.col("h1").alias("a"), F.col("at").alias("at_a")), "a").join(linked.select(F.col("h1").alias("b"), F.col("at").alias("at_b")), "b")
    ends = ends.select(F.explode(F.array(F.struct(F.col("a").alias("h1"), (F.col("at_b") < F.col("at_a")).alias("later")), F.struct(F.col("b").alias("h1"), (F.col("at_a") < F.col("at_b")).alias("later")))).alias("e")).select("e.*")
    per_text = ends.groupBy("h1").agg(F.count("*").alias("n_links"), F.max("later").alias("near"))
    if classes:
        per_text = per_text.join(connected_components(links).select(F.col("node").alias("h1"), F.col("component").alias("linked_class")), "h1")
    else:
        per_text = per_text.withColumn("linked_class", F.lit(None).cast("long"))
    if short:
        seen = seen.unionByName(keyed.where(F.col("length") < LEAST_CHARS).groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n")))
    facts = seen.join(per_text, "h1", "left")
    slim = keyed.select("doc_id", "line_no", "h1", "h2", (F.col("length") < LEAST_CHARS).alias("short"))
    # lines of hot texts never meet in one task: their few facts go to them
    least = max(HOT_LEAST, slim.count() // HOT_SHARE)
    hot = F.broadcast(written(facts.where(F.col("n") > least)))
    marked = slim.join(hot, ["h1", "h2"]).unionByName(slim.join(hot, ["h1", "h2"], "left_anti").join(facts.where(F.col("n") <= least), ["h1", "h2"]))
    return marked.select(
        "doc_id",
        "line_no",
        "h1",
        "short",
        (at == F.col("at")).alias("first"),
        F.coalesce("near", F.lit(False)).alias("near"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "linked_class",
    ), links


def repeated_lines(docs: DataFrame, classes: bool = True, short: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_checked, n_exact, n_near, n_links, removed, n_held_links, n_short, short_repeats, classes) for every row of `docs` (doc_id, text).

    n_lines: \\n-split lines (0 for a null text); n_checked: those of LEAST_CHARS
    or more; n_exact, n_near: lines to remove because an earlier line is equal
    or within EDITS; n_links: different texts within EDITS of its first-seen
    lines; removed: their places, ascending from 0; n_held_links: different
    texts within EDITS of each of its lines, whoever holds the text first;
    n_short: lines of 1 to LEAST_CHARS - 1 characters; short_repeats: places of
    those that an earlier line equals; they are not in `removed` (without
    `short` there are none);
    classes: (line_no, class) of every line with a character, where equal texts and texts
    joined by links share a class (without `classes` the last column is left
    out). Rows that repeat a doc_id are one document, judged together; rows
    without a doc_id are returned unjudged. doc_id may be of any type that has
    an order. Other columns are not read. Empty tables give empty results.
    """
    lines, _ = line_verdicts(docs, classes, short)
    # a repeated row repeats its places: they count once
    line = F.struct("line_no", "h1", "short", "first", "near", "n_links", "linked_class")
    per_doc = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set(line)).alias("lines"))

    def those(which) -> Column:
        return F.filter("lines", which)

    def places(which) -> Column:
        return F.array_distinct(F.transform(those(which), lambda x: x["line_no"]))

    def links(which) -> Column:
        return F.aggregate(those(which), F.lit(0).cast("long"), lambda n, x: n + x["n_links"])

    counts = {
        "n_checked": F.size(those(lambda x: ~x["short"])),
        "n_exact": F.size(those(lambda x: ~x["short"] & ~x["first"])),
        "n_near": F.size(those(lambda x: x["first"] & x["near"])),
        "n_links": links(lambda x: x["first"]),
        "removed": places(lambda x: ~x["short"] & (~x["first"] | x["near"])),
        "n_held_links": links(lambda x: x["line_no"] >= 0),
        "n_short": F.size(those(lambda x: x["short"])),
        "short_repeats": places(lambda x: x["short"] & ~x["first"]),
    }
    if classes:
        counts["classes"] = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), F.coalesce(x["linked_class"], x["h1"]).alias("class")))
    rows = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"))
    both = rows.join(per_doc, "doc_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(per_doc.schema["lines"].dataType)))
    return both.select("doc_id", "n_lines", *[(c.cast("long") if name.startswith("n_") else c).alias(name) for name, c in counts.items()])


def without_repeated_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """`docs` without repeated lines (with `short`, without exact repeats of short ones too), all columns kept; a document that has no word left goes.

    A document without repeated lines stays as it is, null and empty texts too.
    An n_chars column, if there is one, is set to the new length.
    """
    verdict = repeated_lines(docs.select("doc_id", "text"), classes=False, short=short)
    if short:
        verdict = verdict.withColumn("removed", F.concat("removed", "short_repeats"))
    verdict = verdict.where(F.size("removed") > 0).select("doc_id", "removed").dropDuplicates(["doc_id"])
    # the whole row travels as one column, so that no name of its own can clash
    rows = docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    both = rows.join(verdict, "doc_id", "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    joined = F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))[0]
    left = both.withColumn("new", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(joined))
    left = left.where(F.col("removed").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new")).cast(docs.schema["n_chars"].dataType)
    return left.select([changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
