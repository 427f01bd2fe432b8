"""Session ids, directories and file URIs from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _part(path: Column, from_end: int) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(_part(path, 1), r"(.)\.[^.]*$", "$1")


def path_id(path: Column, rule: str) -> Column:
    """Session id of a file by its source's rule.

    stem; after_dash (stem behind its first dash); uuid_tail (last 36 characters
    if they are a UUID, else the stem); after_underscore (behind the last);
    parent, grandparent, great_grandparent (that folder); parent_or_stem (the
    folder if the file has a fixed name, else the stem).
    """
    name = stem(path)
    if rule == "stem":
        return name
    if rule == "after_dash":
        return F.regexp_replace(name, "^[^-]*-", "")
    if rule == "uuid_tail":
        return F.coalesce(F.nullif(F.regexp_extract(name, f"({_UUID})$", 1), F.lit("")), name)
    if rule == "after_underscore":
        return F.regexp_replace(name, "^.*_", "")
    if rule == "parent_or_stem":
        return F.when(name.isin("events", "messages", "updates", "transcript"), _part(path, 2)).otherwise(name)
    return _part(path, {"parent": 2, "grandparent": 3, "great_grandparent": 4}[rule])


def percent_decode(c: Column) -> Column:
    """Percent-decoded; + is kept; what is not valid is kept as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def absolute_dir(c: Column) -> Column:
    """The decoded folder name if it is an absolute path, else null."""
    decoded = percent_decode(c)
    return F.when(F.startswith(decoded, F.lit("/")), decoded)


def uri_to_path(c: Column, keep_other: bool = False) -> Column:
    """Path of a file: URI; others become '' (or stay, if asked)."""
    path = percent_decode(F.regexp_replace(c, r"^file:(//[^/]*)?", ""))
    return F.when(F.startswith(c, F.lit("file:")), path).otherwise(c if keep_other else F.lit(""))
