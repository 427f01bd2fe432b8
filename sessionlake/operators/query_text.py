"""The text of a search as clauses: words, "phrases", + and -, AND, OR, NOT, field:clause.

A clause with several tokens (a phrase, or a word with signs inside) asks for
them next to each other. A quote that is not closed is left out and what follows
are words. Clauses joined by AND are a group that matches as a whole; NOT is -.
A clause of another field than title, content and directory, or without a letter
or digit, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import tokens

FIELDS = ("title", "content", "directory")
_CLAUSE = r'([+-]?)(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|([^\s"]+))'
_OUT = "array<struct<clause: int, group: int, sign: string, field: string, text: string>>"


def _typed_clauses(text: Column) -> Column:
    """Clauses in order: those joined by AND share a group; sign is '+', '-' or ''."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(g)).alias(f"g{g}") for g in range(5)])
    start = F.struct(F.lit(0).alias("group"), F.lit(False).alias("both"), F.lit(False).alias("no"), F.array().cast(_OUT).alias("out"))

    def step(state: Column, x: Column) -> Column:
        word = F.when((x["g0"] == x["g4"]) & x["g0"].isin("AND", "OR", "NOT"), x["g0"]).otherwise("")
        group = F.when(state["both"] & (state["group"] > 0), state["group"]).otherwise(state["group"] + 1)
        body = F.when(F.endswith(x["g0"], F.lit('"')), x["g3"]).otherwise(x["g4"])
        clause = F.struct(
            F.size(state["out"]).alias("clause"), group.alias("group"), F.when(state["no"], "-").otherwise(x["g1"]).alias("sign"),
            F.lower(x["g2"]).alias("field"), body.alias("text"),
        )
        return (
            F.when(word == "", F.struct(group.alias("group"), F.lit(False).alias("both"), F.lit(False).alias("no"), F.array_append(state["out"], clause).alias("out")))
            .otherwise(F.struct(state["group"], F.when(word == "NOT", state["both"]).otherwise(word == "AND").alias("both"), (word == "NOT").alias("no"), state["out"]))
        )

    return F.aggregate(parts, start, step, lambda state: state["out"])


def clause_list(text: Column) -> Column:
    """Array of (clause, group, sign, field, raw, terms) of a text; field '' is any; group is null for a clause that stands alone."""
    each = F.transform(_typed_clauses(text), lambda c: F.struct(c["clause"].alias("clause"), c["group"].alias("group"), c["sign"].alias("sign"), c["field"].alias("field"), c["text"].alias("raw"), tokens(c["text"]).alias("terms")))
    return F.filter(each, lambda c: (F.size(c["terms"]) > 0) & c["field"].isin("", *FIELDS))


def clauses(parsed: DataFrame) -> DataFrame:
    """(query_id, clause, group, sign, field, raw, terms) of the queries' texts."""
    typed = parsed.select("query_id", clause_list(F.col("text")).alias("cs"))
    return typed.select("query_id", F.inline(with_groups(F.col("cs"))))


def with_groups(cs: Column) -> Column:
    """Clauses whose group has no other one stand alone: what was left out leaves no trace."""
    groups = F.transform(cs, lambda c: c["group"])

    def apart(c: Column) -> Column:
        shared = F.when(F.size(F.filter(groups, lambda g: g == c["group"])) > 1, c["group"])
        return F.struct(c["clause"].alias("clause"), shared.alias("group"), c["sign"].alias("sign"), c["field"].alias("field"), c["raw"].alias("raw"), c["terms"].alias("terms"))

    return F.transform(cs, apart)


def rule(cs: Column) -> tuple[Column, Column, Column, Column]:
    """(must, nots, shoulds, groups): how clauses (with_groups) decide; groups: (group, must, nots) of clauses joined by AND."""

    def numbers(which) -> Column:
        return F.transform(F.filter(cs, which), lambda c: c["clause"])

    def alone(sign: str) -> Column:
        return numbers(lambda c: c["group"].isNull() & (c["sign"] == sign))

    joined = F.array_distinct(F.array_compact(F.transform(cs, lambda c: c["group"])))
    groups = F.transform(joined, lambda g: F.struct(g.alias("group"), numbers(lambda c: (c["group"] == g) & (c["sign"] != "-")).alias("must"), numbers(lambda c: (c["group"] == g) & (c["sign"] == "-")).alias("nots")))
    return alone("+").alias("must"), alone("-").alias("nots"), alone("").alias("shoulds"), groups.alias("groups")


def matched_groups(met: Column) -> Column:
    """Numbers of the groups of a rule that match, where `met` are the clauses that a session meets."""
    return F.transform(F.filter("groups", lambda g: (F.size(F.array_except(g["must"], met)) == 0) & (F.size(g["must"]) > 0) & ~F.arrays_overlap(g["nots"], met)), lambda g: g["group"])


def passes(met: Column, groups: Column) -> Column:
    """Whether a session that meets the clauses `met` and matches `groups` matches the rule."""
    some = F.arrays_overlap(F.col("shoulds"), met) | (F.size(groups) > 0)
    return (F.size(F.array_except(F.col("must"), met)) == 0) & ~F.arrays_overlap(F.col("nots"), met) & ((F.size("must") > 0) | some)
