"""Node and edge tables of the graph. All upserts are keyed and idempotent: the last row of a key stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.errors import GraphConstructionError
from graphweave.functions.text import safe_label

# The entity types that are counted as known.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "CONCEPT", "TECHNOLOGY", "LOCATION", "EVENT", "DATE", "METRIC", "DOCUMENT", "LAW", "PRODUCT")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key from both tables; ``order`` is a column that grows with later writes. Of different rows at the
    same place one stays, by a hash of the whole row."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(order, F.xxhash64(F.to_json(F.struct(*rows.columns)))))
    # the keys are those of the groups, so that a filter on them comes before the grouping
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*[c if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def check_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if its keys are unique and not null, else an error; stands for a database's uniqueness constraint."""
    doubled = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not df.where(" or ".join(f"{k} is null" for k in keys)).isEmpty() or not doubled.isEmpty():
        raise GraphConstructionError(f"{keys} is no key")
    return df


def chunk_nodes(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with their summary, empty where there is none; repeated deliveries count once."""
    once = upsert(None, chunks, ["chunk_id"], "ingested_at") if "ingested_at" in chunks.columns else chunks.dropDuplicates(["chunk_id"])
    summary = summaries.groupBy("chunk_id").agg(F.max("summary").alias("summary"))
    return once.join(summary, "chunk_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def entity_nodes(entities: DataFrame) -> DataFrame:
    return entities.select("name", "type", "description", "aliases", *(["embedding"] if "embedding" in entities.columns else []))


def typed_edges(edges: DataFrame, entities: DataFrame, order: list[str]) -> DataFrame:
    """``source_entity, label, target_entity, description, weight``: types that give one label collapse, the last stays."""
    rows = edges.withColumn("label", safe_label(F.col("relation_type")))
    for side in ("source_entity", "target_entity"):
        rows = rows.join(entities.select(F.col("name").alias(side)).distinct(), side, "left_semi")
    last = F.max_by(F.struct("description", "weight"), F.struct(*order))
    return rows.groupBy("source_entity", "label", "target_entity").agg(last.alias("last")).select("source_entity", "label", "target_entity", "last.*")


def extracted_from(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """``entity_name, chunk_id``: the chunks that exist among each entity's sources."""
    rows = entities.select(F.col("name").alias("entity_name"), F.explode("source_chunk_ids").alias("chunk_id")).where("entity_name is not null")
    return rows.distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("entity_name", "chunk_id")


def next_chunk(chunks: DataFrame, key: str = "file_hash") -> DataFrame:
    """``current_chunk_id, next_chunk_id``: consecutive chunks of each document; missing indexes are skipped."""
    rows = chunks.where("chunk_index is not null").select(key, "chunk_id", "chunk_index").distinct()
    after = F.lead("chunk_id").over(Window.partitionBy(key).orderBy("chunk_index", "chunk_id"))
    return rows.select(F.col("chunk_id").alias("current_chunk_id"), after.alias("next_chunk_id")).where("next_chunk_id is not null")


def document_nodes(metadata: DataFrame) -> DataFrame:
    """One row for each file, the last delivered."""
    return upsert(None, metadata, ["file_hash"], "ingested_at")


def part_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_id, file_hash`` of the chunks whose document exists."""
    return chunks.select("chunk_id", "file_hash").distinct().join(documents.select("file_hash"), "file_hash", "left_semi").select("chunk_id", "file_hash")


def type_quality(entities: DataFrame) -> DataFrame:
    """``type, known, n``: how often each type occurs, and whether it is in the vocabulary."""
    rows = entities.select(F.upper("type").alias("type"))
    return rows.groupBy("type").agg(F.count("*").alias("n")).withColumn("known", F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)))


def node_counts(**tables: DataFrame) -> DataFrame:
    """``label, n`` of the given tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole
