"""Contexts for an answer, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import TOKEN, WS, token_count

# The headers of a context's parts.
ENTITY_HEADER, EDGE_HEADER, CHUNK_HEADER = "=== RELEVANT ENTITIES ===", "=== KEY RELATIONSHIPS ===", "=== RELEVANT TEXT PASSAGES ==="


def _joined(rows: DataFrame, line: Column, order: list[Column], header: str, sep: str, name: str) -> DataFrame:
    """The lines of each question in order under a header; the rows are those that a budget left."""
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    text = F.array_join(F.concat(F.array(F.lit(header)), F.transform(ordered, lambda x: x["line"])), sep)
    return rows.groupBy("question_id").agg(text.alias(name))


def _leading(rows: DataFrame, line: Column, order: list[Column], budget: int, least: int) -> DataFrame:
    """``question_id, o0, o1, ..., line``: the lines of each question up to the one with which they reach the budget.

    A line has at least ``least`` tokens, so its rank alone rules most out; Spark cuts by rank in each part before it shuffles,
    and a question with many lines is never in one task as a whole.
    """
    keys = [f"o{i}" for i in range(len(order))]
    rows = rows.select("question_id", *[c.alias(k) for k, c in zip(keys, order)], line.alias("line")).where("line is not null")
    by = Window.partitionBy("question_id").orderBy(*[F.asc_nulls_last(k) for k in keys], "line")
    rows = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= budget // least + 1)
    before = F.sum(token_count(F.col("line"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).select("question_id", *keys, "line")


def entity_section(hits: DataFrame, budget: int = 2500) -> DataFrame:
    """``question_id, entity_section`` from ``question_id, name, type, description, combined_score``; lines beyond the budget are left out."""
    blank = F.lit("")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.coalesce("type", blank), F.lit("): "), F.coalesce("description", blank))
    kept = _leading(hits, line, [-F.col("combined_score"), F.col("name")], budget, 4)
    return _joined(kept, F.col("line"), [F.col("o0"), F.col("o1")], ENTITY_HEADER, "\n", "entity_section")


def edge_section(edges: DataFrame, budget: int = 2500) -> DataFrame:
    """``question_id, edge_section`` from a question's edges with ``label``; lines beyond the budget are left out."""
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("source_entity"), F.lit(" --["), F.col("label"), F.lit("]--> "), F.col("target_entity"), told)
    kept = _leading(edges.distinct(), line, [F.col("source_entity"), F.col("target_entity"), F.col("label")], budget, 8)
    return _joined(kept, F.col("line"), [F.col("o0"), F.col("o1"), F.col("o2")], EDGE_HEADER, "\n", "edge_section")


def within_budget(entries: DataFrame, order: list[str], budget: Column, key: str = "question_id") -> DataFrame:
    """The entries of each question up to the first that no longer fits with those before it and the header."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("tokens").over(upto) + F.size(F.regexp_extract_all(F.lit(CHUNK_HEADER), F.lit(TOKEN), F.lit(0)))
    return entries.withColumn("spent", spent).where(F.col("spent") <= budget)


def truncated(text: Column, tokens: int) -> Column:
    """The first ``tokens`` tokens of a text, with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{WS}*(?:{TOKEN})"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, tokens), "")


def contexts(hits: DataFrame, edges: DataFrame, chunks: DataFrame, budget: int = 2500, questions: DataFrame | None = None) -> DataFrame:
    """``question_id, context, tokens``: entities, relationships, then as many passages as the rest of the budget holds.
    Where entities and relationships alone pass the budget, the text ends with its last token.

    ``chunks`` has ``question_id, chunk_id, text, source_file, hop``. All ``questions``, or all with hits, have a row; a part
    without lines is its header.
    """
    asked = (hits if questions is None else questions).select("question_id").distinct()
    told = asked.join(entity_section(hits, budget), "question_id", "left").join(edge_section(edges, budget), "question_id", "left")
    headers = {"entity_section": ENTITY_HEADER, "edge_section": EDGE_HEADER}
    told = told.withColumns({name: F.coalesce(name, F.lit(header)) for name, header in headers.items()})
    used = token_count(F.col("entity_section")) + token_count(F.col("edge_section"))
    told = told.withColumn("left_over", F.greatest(F.lit(0), F.lit(budget) - used))
    entry = F.concat(F.lit("[Chunk "), F.col("chunk_id"), F.lit("] (Source: "), F.coalesce("source_file", F.lit("")), F.lit("):\n"), F.col("text"))
    passages = chunks.withColumn("entry", entry).withColumn("tokens", token_count(F.col("entry")))
    passages = passages.join(told.select("question_id", "left_over"), "question_id")
    kept = within_budget(passages, ["hop", "chunk_id"], F.col("left_over"))
    section = _joined(kept, F.col("entry"), [F.col("hop"), F.col("chunk_id")], CHUNK_HEADER, "\n\n", "chunk_section")
    whole = told.join(section, "question_id", "left")
    text = F.concat_ws("\n\n", "entity_section", "edge_section", F.coalesce("chunk_section", F.lit(CHUNK_HEADER)))
    whole = whole.select("question_id", text.alias("context")).withColumn("tokens", token_count(F.col("context")))
    text = F.when(F.col("tokens") > budget, truncated(F.col("context"), budget)).otherwise(F.col("context"))
    return whole.select("question_id", text.alias("context"), F.least("tokens", F.lit(budget)).alias("tokens"))
