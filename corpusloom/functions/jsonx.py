"""Recovery of JSON objects from model replies, and template filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(raw: Column) -> Column:
    """The outermost object of a reply: without fences and prose, trailing commas repaired."""
    plain = F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_extract(plain, r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")


def parse(raw: Column, schema: str) -> Column:
    """Struct of a reply, null fields where it has none; never raises."""
    return F.from_json(json_text(raw), schema, {"mode": "PERMISSIVE"})


def map_reply(raw: Column) -> Column:
    """Partial answer, confidence and evidence of a map reply; plain text counts with 0.4."""
    p = parse(raw, "partial_answer STRING, fragment STRING, answer STRING, confidence DOUBLE, evidence ARRAY<STRING>")
    text = F.coalesce(p["partial_answer"], p["fragment"], p["answer"])
    return F.struct(F.coalesce(text, F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, 2000)).alias("partial"), F.coalesce(p["confidence"], F.when(text.isNull(), 0.4).otherwise(0.6)).alias("confidence"), F.coalesce(p["evidence"], F.array().cast("array<string>")).alias("evidence"))


def reduce_reply(raw: Column) -> Column:
    """Answer, used ids and confidence of a reduce reply; plain text counts with 0.5."""
    p = parse(raw, "answer STRING, final_answer STRING, final STRING, used ARRAY<STRING>, confidence DOUBLE")
    text = F.coalesce(p["answer"], p["final_answer"], p["final"])
    return F.struct(F.coalesce(text, F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, 2000)).alias("answer"), F.coalesce(p["used"], F.array().cast("array<string>")).alias("used"), F.coalesce(p["confidence"], F.when(text.isNull(), 0.5).otherwise(0.6)).alias("confidence"))


def link_reply(raw: Column, ids: Column) -> Column:
    """Winner of a linking reply, only if it is one of ``ids``; null means none."""
    winner = parse(raw, "winner STRING, confidence DOUBLE")["winner"]
    return F.when(F.array_contains(ids, winner), winner)


def dump(value: Column) -> Column:
    """JSON of a struct or map; null gives "{}"."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def now_ms() -> Column:
    """Milliseconds since the epoch, the same in all rows of a query."""
    return F.unix_millis(F.current_timestamp())


def render(template: str, **values: Column) -> Column:
    """Template with ``{{name}}`` places filled; all other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
