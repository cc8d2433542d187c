"""Entity resolution by normal names and aliases, and what follows for edges.

Mentions are ``pos, name, type, description, aliases, source_chunk_ids``; ``pos`` is their order, a number or a struct, and breaks all
ties. Null and blank names are left out, null lists count as empty. Where mentions have an ``embedding``, an entity has that of
its first mention with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.errors import EntityResolutionError
from graphweave.functions.text import name_key
from graphweave.session import checkpointed, small

MOST_ROUNDS = 50
#: Halvings after which nothing is left of a weight in [0, 1] in double precision, the smallest of which is 2^-1074.
FOLDED = 1100


def _listed(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _most_common(mentions: DataFrame, column: str) -> DataFrame:
    """The most frequent value of each key, the first seen among equals; counted before the keys are brought together."""
    counts = mentions.where(F.col(column).isNotNull()).groupBy("key", column).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("key").agg(F.min_by(column, F.struct(-F.col("n"), "first")).alias(column))


def _embedded(df: DataFrame, order: str) -> list[Column]:
    """The first embedding in the given order, if there are any."""
    if "embedding" not in df.columns:
        return []
    found = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return [F.min_by("embedding", F.when(found, F.col(order))).alias("embedding")]


def grouped(mentions: DataFrame) -> DataFrame:
    """``key, name, type, description, aliases, source_chunk_ids, mentions, first``: one row for each normal name."""
    rows = mentions.withColumn("key", name_key(F.col("name"))).where("key != ''")
    described = F.when(F.col("description") != "", F.col("description"))
    spelled = rows.select("key", F.explode(F.concat(_listed("aliases"), F.array("name"))).alias("alias")).where("alias is not null").distinct()
    chunks = rows.select("key", F.explode(_listed("source_chunk_ids")).alias("chunk")).where("chunk is not null").distinct()
    whole = rows.groupBy("key").agg(
        F.min_by(described, F.when(described.isNotNull(), F.struct(-F.length(described), "pos"))).alias("description"),
        F.count("*").alias("mentions"), F.min("pos").alias("first"), *_embedded(rows, "pos"),
    )
    whole = whole.join(_most_common(rows, "name"), "key").join(_most_common(rows, "type"), "key", "left")
    whole = whole.join(spelled.groupBy("key").agg(F.array_sort(F.collect_set("alias")).alias("aliases")), "key", "left")
    whole = whole.join(chunks.groupBy("key").agg(F.array_sort(F.collect_set("chunk")).alias("source_chunk_ids")), "key", "left")
    return whole.select(
        "key", "name", "type", F.coalesce("description", F.lit("")).alias("description"),
        F.array_except(_listed("aliases"), F.array("name")).alias("aliases"), _listed("source_chunk_ids").alias("source_chunk_ids"), "mentions", "first", *(["embedding"] if "embedding" in whole.columns else []),
    )


def type_conflicts(mentions: DataFrame) -> DataFrame:
    """``key, types``: normal names that are mentioned with more than one type."""
    rows = mentions.withColumn("key", name_key(F.col("name"))).where("key != '' and type is not null")
    return rows.groupBy("key").agg(F.count_distinct("type").alias("types")).where("types > 1")


def alias_links(entities: DataFrame) -> DataFrame:
    """``a, b``: keys of which one is an alias of the other, each pair once."""
    alias = entities.select("key", F.explode("aliases").alias("alias")).select("key", name_key(F.col("alias")).alias("other"))
    known = entities.select(F.col("key").alias("other"))
    alias = alias.where("other != '' and other != key").distinct().join(known, "other", "left_semi")
    return alias.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``key, component``: the smallest key that each linked key is connected with, by iterated joins to a fixpoint."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).toDF("key", "other"))
    labels = checkpointed(both.groupBy("key").agg(F.least(F.col("key"), F.min("other")).alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("key").alias("other"), F.col("component").alias("near")), "other")
        near = near.groupBy("key").agg(F.min("near").alias("near")).join(labels, "key")
        # the component's own label moves too, which halves the longest chain
        jump = labels.select(F.col("key").alias("near"), F.col("component").alias("far"))
        moved = near.join(jump, "near", "left").select("key", F.least("component", "near", "far").alias("component"), F.col("component").alias("old"))
        moved = checkpointed(moved)
        labels = moved.select("key", "component")
        if moved.where("component != old").isEmpty():
            return labels
    raise EntityResolutionError(f"alias components did not settle in {MOST_ROUNDS} rounds")


def merged(entities: DataFrame) -> DataFrame:
    """Entities with those joined that are aliases of each other. The member with most mentions, the first among equals,
    gives name and type; no alias, chunk or description is lost."""
    entities = checkpointed(entities)
    of = components(alias_links(entities))
    rows = entities.join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rank = F.struct(-F.col("mentions"), "first")
    spelled = rows.select("component", F.explode(F.concat("aliases", F.array("name"))).alias("alias")).distinct()
    chunks = rows.select("component", F.explode("source_chunk_ids").alias("chunk")).distinct()
    whole = rows.groupBy("component").agg(
        F.min_by(F.struct("key", "name", "type"), rank).alias("top"),
        F.min_by("description", F.struct(-F.length("description"), "first")).alias("description"),
        F.sum("mentions").alias("mentions"), F.min("first").alias("first"), *_embedded(rows, "first"),
    )
    whole = whole.join(spelled.groupBy("component").agg(F.array_sort(F.collect_set("alias")).alias("aliases")), "component", "left")
    whole = whole.join(chunks.groupBy("component").agg(F.array_sort(F.collect_set("chunk")).alias("source_chunk_ids")), "component", "left")
    return whole.select(
        "top.*", "description", F.array_except(_listed("aliases"), F.array("top.name")).alias("aliases"),
        _listed("source_chunk_ids").alias("source_chunk_ids"), "mentions", "first", *(["embedding"] if "embedding" in whole.columns else []),
    )


def surface_forms(entities: DataFrame) -> DataFrame:
    """``key, name``: the entity that each normal name or alias stands for; the last entity in order wins."""
    rows = entities.select("first", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("spelled"))
    rows = rows.select(name_key(F.col("spelled")).alias("key"), "name", "first").where("key != ''")
    return rows.groupBy("key").agg(F.max_by("name", F.struct("first", "name")).alias("name"))


def remapped(edges: DataFrame, forms: DataFrame) -> DataFrame:
    """``edges`` with both endpoints as entity names; unknown ones stay as they are. Few forms are broadcast, so that the edges,
    and those of one frequent endpoint, stay where they are."""
    forms = small(checkpointed(forms.select("key", "name")))
    for side in ("source_entity", "target_entity"):
        known = forms.select(F.col("key").alias("_key"), F.col("name").alias("_name"))
        edges = edges.withColumn("_key", name_key(F.col(side))).join(known, "_key", "left")
        edges = edges.withColumn(side, F.coalesce("_name", side)).drop("_key", "_name")
    return edges


def connected(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """The edges between two different known entities."""
    edges = edges.where("source_entity != target_entity")
    names = small(checkpointed(entities.select("name").where("name is not null").distinct()))
    for side in ("source_entity", "target_entity"):
        edges = edges.join(names.withColumnRenamed("name", side), side, "left_semi")
    return edges


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """The edges with an endpoint that is no entity."""
    names = entities.select("name")
    no_source = edges.join(names, edges["source_entity"] == names["name"], "left_anti")
    return no_source.union(edges.join(names, edges["source_entity"] == names["name"], "left_semi").join(names, edges["target_entity"] == names["name"], "left_anti"))


def folded(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each source, target and type. Weights are averaged one after the other in the given order, as a
    running mean of old and new; the longest description, the first among equals, stays; ``arrived`` is the place of the last.

    Such a mean counts the last weight half, the one before a quarter and so on, the first as much as the second. The share of
    what lies ``FOLDED`` places behind the last is no double but 0. So each task keeps so many rows of a key at most, however
    many edges it has, and the result is that of all of them.
    """
    keys = ["source_entity", "target_entity", "relation_type"]
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    total = edges.groupBy(*keys).agg(
        F.count("*").alias("mentions"),
        F.min_by("description", F.struct(-F.length(F.coalesce("description", F.lit(""))), *order)).alias("description"),
        F.max(F.struct(*order)).alias("arrived"),
    )
    late = edges.select(*keys, *order, "weight").withColumn("_j", F.row_number().over(back)).where(F.col("_j") <= FOLDED).select(*keys, "_j", "weight")
    late = late.join(total.select(*keys, "mentions"), keys)
    share = F.pow(F.lit(0.5), F.col("_j") - F.when(F.col("_j") == F.col("mentions"), 1).otherwise(0))
    weight = late.groupBy(*keys).agg(F.sum(F.col("weight") * share).alias("weight"))
    chunks = edges.select(*keys, F.explode(_listed("source_chunk_ids")).alias("chunk")).distinct()
    held = chunks.groupBy(*keys).agg(F.array_sort(F.collect_set("chunk")).alias("source_chunk_ids"))
    return total.join(weight, keys).join(held, keys, "left").withColumn("source_chunk_ids", _listed("source_chunk_ids"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The entities without an edge."""
    touched = edges.select(F.col("source_entity").alias("name")).union(edges.select(F.col("target_entity").alias("name"))).distinct()
    return entities.join(touched, "name", "left_anti")


def embedding_text(entities: DataFrame) -> DataFrame:
    """``entities`` with the text that an embedder reads."""
    blank = F.lit("")
    text = F.concat("name", F.lit(": "), F.coalesce("type", blank), F.lit(". "), F.coalesce("description", blank))
    return entities.withColumn("embedding_text", text)
