"""Rules that reject chunks, and the counts of their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import WS, lines, strip

# What the rules look for.
HEADING_ONLY = rf"^\[[^\n]+\]{WS}*\z"
KEYWORD_ONLY = rf"(?i)^{WS}*(?:table{WS}+of{WS}+contents|references|bibliography|index){WS}*\z"
CONTENTS = rf"(?i)table{WS}+of{WS}+contents|contents|list{WS}+of{WS}+(?:figures|tables)"
REFERENCE = rf"^{WS}*(?:\[\p{{Nd}}+\]|\p{{Nd}}+\.){WS}+[A-Z]"


def is_boilerplate(text: Column) -> Column:
    """A lone keyword behind the bracketed headings, contents words in the first three lines, or mostly references."""
    behind = F.when(text.startswith("[") & text.contains("]\n"), F.expr("substring(body, locate(']\\n', body) + 2)")).otherwise(text)
    every = lines(text)
    cited = F.size(F.filter(every, lambda x: x.rlike(REFERENCE)))
    return strip(behind).rlike(KEYWORD_ONLY) | F.array_join(F.slice(every, 1, 3), "\n").rlike(CONTENTS) | ((F.size(every) > 3) & (cited / F.size(every) > 0.6))


def is_numeric(text: Column) -> Column:
    """More than 80 percent of the characters besides white space are digits."""
    seen = F.length(F.regexp_replace(text, rf"{WS}", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return (seen > 0) & (digits > 0.8 * seen)


def judged(chunks: DataFrame, least: int = 30, key: str = "file_hash") -> DataFrame:
    """``chunks`` with ``reasons``, empty for accepted ones.

    The rules depend on the text alone, so copies pass or fail together and the first copy of a document by index is the
    accepted one; where the chunks come with ``repeated`` that tells the others, and nothing is shuffled. Null texts and counts
    fail as too short.
    """
    rows = chunks.withColumn("body", F.coalesce(strip(F.col("text")), F.lit("")))
    body = F.col("body")
    rules = {
        "too short": F.coalesce(F.col("token_count"), F.lit(0)) < least, "heading only": body.rlike(HEADING_ONLY),
        "boilerplate": is_boilerplate(body), "numeric": is_numeric(body),
    }
    reasons = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("reasons", reasons)
    if "repeated" in chunks.columns:
        copy = (F.size("reasons") == 0) & F.col("repeated")
        return rows.withColumn("reasons", F.when(copy, F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("body", "repeated")
    first = Window.partitionBy(key, F.xxhash64("body"), "body").orderBy(F.col("chunk_index").asc_nulls_last(), "chunk_id")
    copy = (F.size("reasons") == 0) & (F.row_number().over(first) > 1)
    return rows.withColumn("reasons", F.when(copy, F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("body")


def valid(chunks: DataFrame, least: int = 30, key: str = "file_hash") -> DataFrame:
    """The accepted chunks."""
    return judged(chunks, least, key).where(F.size("reasons") == 0).drop("reasons")


def reason_counts(chunks: DataFrame, least: int = 30, key: str = "file_hash") -> DataFrame:
    """``reason, n``: how many chunks each reason rejects; a chunk can have several."""
    return judged(chunks, least, key).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
