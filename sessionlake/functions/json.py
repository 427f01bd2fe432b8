"""JSON text and variants. Needs spark.sql.variant.allowDuplicateKeys=true (model.configure)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "@@end"


def is_strict_json(c: Column) -> Column:
    """Whether the text is one complete JSON value with nothing behind it.

    The parser alone ignores what follows a value, so the text is parsed as the
    first of two array elements and the second must still be found.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_END}"]')))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    blank = ~F.coalesce(c.rlike(r"\S"), F.lit(False))
    two = (F.size(items) == 2) & (F.try_variant_get(wrapped, "$[1]", "string") == _END)
    return F.when(blank, False).otherwise(F.coalesce(two, F.lit(False)))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is STRING, ARRAY<..>, OBJECT<..>, BOOLEAN ... ."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def content_texts(v: Column) -> Column:
    """Texts of a message's content, empties dropped.

    A string is its own text; of an array, each part's `text`, else
    `input_text`, else the part itself if it is a string; anything else none.
    """
    parts = F.try_variant_get(v, "$", "array<variant>")
    each = F.transform(parts, lambda p: F.coalesce(_string(p, "$.text"), _string(p, "$.input_text"), _string(p, "$")))
    texts = F.when(is_kind(v, "STRING"), F.array(get(v, "$"))).when(is_kind(v, "ARRAY"), each).otherwise(F.array().cast("array<string>"))
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def _string(v: Column, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(is_kind(inner, "STRING"), F.try_variant_get(v, path, "string"))


def typed_texts(v: Column, kind: str = "text") -> Column:
    """As content_texts, but of an array only parts whose `type` is `kind`."""
    parts = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == kind)
    each = F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string"))
    texts = F.when(is_kind(v, "STRING"), F.array(get(v, "$"))).when(is_kind(v, "ARRAY"), each).otherwise(F.array().cast("array<string>"))
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def tool_summaries(raw: Column) -> Column:
    """One line for a message's parts (JSON array text), null if it cannot be parsed.

    Text parts as they are; results of 1 to 499 characters as `[name]: first
    200`; calls as `[calling name]`; joined by a space.
    """
    parsed = F.try_parse_json(raw)
    parts = F.try_variant_get(parsed, "$", "array<variant>")

    def line(p: Column) -> Column:
        kind, body = F.try_variant_get(p, "$.type", "string"), F.try_variant_get(p, "$.data.content", "string")
        name = F.coalesce(F.nullif(F.try_variant_get(p, "$.data.name", "string"), F.lit("")), F.lit("tool"))
        result = F.when(F.char_length(body).between(1, 499), F.concat(F.lit("["), name, F.lit("]: "), F.substring(body, 1, 200)))
        return F.when(kind == "text", F.nullif(F.try_variant_get(p, "$.data.text", "string"), F.lit(""))).when(kind == "tool_result", result).when(kind == "tool_call", F.concat(F.lit("[calling "), name, F.lit("]")))

    return F.when(is_strict_json(raw), F.array_join(F.filter(F.transform(parts, line), lambda x: x.isNotNull()), " "))
