"""The recall gate: ordered rules that say why a message deserves no recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import schemas as S
from palimpsest.functions.text import CJK, Tagger, strip
from palimpsest.params import DEFAULT, Params


def gate_reason(text: Column, p: Params = DEFAULT) -> Column:
    """The first rule that fits, or an empty string where recall goes on. Total: null and blank texts are 'empty'."""
    s = strip(F.coalesce(text, F.lit("")))
    fillers = sorted({f.lower() for f in S.FILLERS} | set(S.FILLERS))
    bare = F.regexp_replace(s, r"[!.。?？,，~～ ]+$", "")
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    distinct = F.size(F.array_distinct(F.filter(F.split(F.replace(s, F.lit(" "), F.lit("")), ""), lambda ch: ch != "")))
    return (
        F.when(s == "", "empty")
        .when(F.length(s) < p.gate_min_len, "too_short")
        .when(F.length(s) > p.gate_max_len, "too_long")
        .when(F.lower(s).isin(fillers), "filler")
        .when(F.lower(bare).isin(fillers), "filler_with_punct")
        .when(s.rlike(rf"(?U)\b{S.SWEAR}\b"), "swear")
        .when(s.rlike(S.VENT), "emotional_vent")
        .when(~s.rlike(CJK) & (words < 3), "pure_command")
        .when((distinct <= 2) & (F.length(s) > 6), "repeated_chars")
        .otherwise("")
    )


def has_noun(text: Column, tagger: Tagger | None = None) -> Column:
    """Soft gate: a noun or identifier by the tagger; without one a Latin identifier or a Han character. Only logged."""
    if tagger:
        return F.exists(tagger(text), lambda w: w["kind"].startswith("n") | (w["kind"] == "eng"))
    return text.rlike(r"[A-Za-z0-9_-]{2,}") | text.rlike(CJK)


def gate(messages: DataFrame, column: str = "text", p: Params = DEFAULT) -> DataFrame:
    return messages.withColumn("reason", gate_reason(F.col(column), p)).withColumn("skip", F.col("reason") != "")
