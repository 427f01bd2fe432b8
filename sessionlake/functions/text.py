"""Titles, labels, tokens, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(r"\S"), c)


def truncate_title(c: Column, limit: int, word_break: bool = True) -> Column:
    """Trimmed text of at most `limit` code points, else cut (at the last space, if asked) with '...'."""
    t = trimmed(c)
    head = F.substring(t, 1, limit)
    if word_break:
        head = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(head, F.lit("...")))


def all_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def is_term(token: Column) -> Column:
    """Whether a token is indexed: those of 40 bytes or more are not."""
    return F.octet_length(token) < 40


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, those of 40 bytes or more left out."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda t: (t != "") & is_term(t))


def display_dir(directory: Column, home: str) -> Column:
    """`home` as ~; empty as n/a."""
    inside = (directory == home) | F.startswith(directory, F.lit(home + "/"))
    return F.when(directory == "", F.lit("n/a")).when(inside, F.concat(F.lit("~"), F.substring(directory, len(home) + 1, 1 << 30))).otherwise(directory)


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 up to TB, one decimal above bytes."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def age_label(ts: Column, as_of: Column) -> Column:
    """now, then minutes, hours, days, months of 30 and years of 365 days."""
    s = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000)

    def label(seconds: int, suffix: str) -> Column:
        return F.concat(F.floor(s / seconds).cast("string"), F.lit(suffix))

    day = 86400
    return (
        F.when(s < 60, F.lit("now")).when(s < 3600, label(60, "m")).when(s < day, label(3600, "h")).when(s < 30 * day, label(day, "d"))
        .when(s < 365 * day, label(30 * day, "mo")).otherwise(label(365 * day, "y"))
    )


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def first_hit(content: Column, terms: Sequence[str]) -> Column:
    """1-based place of the earliest ASCII-case-insensitive occurrence of any term, null if none."""
    folded = ascii_lower(content)
    places = [F.nullif(F.locate("".join(LOWER[UPPER.index(ch)] if ch in UPPER else ch for ch in t), folded), F.lit(0)) for t in terms if t]
    if not places:
        return F.lit(None).cast("int")
    return F.array_min(F.filter(F.array(*places), lambda p: p.isNotNull()))


def snippet(content: Column, terms: Sequence[str], before: int = 221, after: int = 5000, whole: int = 6000) -> Column:
    """Text around the earliest hit, marked where it is cut; the beginning if there is none."""
    hit = first_hit(content, terms)
    start = F.greatest(hit - before, F.lit(1))
    text = F.substring(content, start, hit - start + after)
    left = F.when(start > 1, F.lit("...\n")).otherwise("")
    right = F.when(F.char_length(content) > hit - 1 + after, F.lit("\n...")).otherwise("")
    head = F.concat(F.substring(content, 1, whole), F.when(F.char_length(content) > whole, F.lit("\n...")).otherwise(""))
    return F.when(hit.isNull(), head).otherwise(F.concat(left, text, right))


def highlight(content: Column, terms: Sequence[str], opening: str = "[[", closing: str = "]]") -> Column:
    """Marks each occurrence, left to right; of terms that start at one place the first listed wins."""
    wanted = [re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", t) for t in terms if t]
    return F.regexp_replace(content, f"(?i)({'|'.join(wanted)})", f"{opening}$1{closing}") if wanted else content
