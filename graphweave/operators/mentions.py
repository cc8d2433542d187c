"""Entity and relationship mentions from replies of an extractor, in JSON or in delimited tuples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.text import relation_type, strip, unit_weight

#: An extractor's reply. Weights are read as text, so that a wrong type loses one weight and no row.
REPLY = (
    "entities array<struct<name:string,type:string,description:string,aliases:array<string>>>, "
    "relationships array<struct<source_entity:string,target_entity:string,relation_type:string,description:string,weight:string>>, "
    "summary string, keywords array<string>"
)


def parse_reply(reply: Column, schema: str = REPLY) -> Column:
    """The reply as a struct, taken out of a code fence if there is one; null if it is no JSON."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(reply), schema)


def extract(chunks: DataFrame, extractor: Callable[[str, str], str]) -> DataFrame:
    """``chunk_id, reply, error``: an injected extractor's reply for each chunk; a failure becomes the row's error."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame["chunk_id"], frame["text"]):
                try:
                    rows.append((key, extractor(key, text), None))
                except Exception as e:  # noqa: BLE001 - one chunk's failure must not end the job
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["chunk_id", "reply", "error"])

    return chunks.select("chunk_id", "text").mapInPandas(work, "chunk_id string, reply string, error string")


def entity_mentions(replies: DataFrame) -> DataFrame:
    """``chunk_id, pos, name, type, description, aliases``; nameless ones are left out, null aliases are none."""
    rows = replies.select("chunk_id", F.posexplode(parse_reply(F.col("reply"))["entities"]).alias("pos", "e"))
    name = strip(F.col("e.name"))
    return rows.where(name != "").select(
        "chunk_id", F.col("pos").cast("bigint").alias("pos"), name.alias("name"),
        F.coalesce(F.nullif(strip(F.col("e.type")), F.lit("")), F.lit("CONCEPT")).alias("type"),
        F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def relationship_mentions(replies: DataFrame) -> DataFrame:
    """``chunk_id, pos, source_entity, target_entity, relation_type, description, weight``, both endpoints given."""
    rows = replies.select("chunk_id", F.posexplode(parse_reply(F.col("reply"))["relationships"]).alias("pos", "r"))
    source, target = strip(F.col("r.source_entity")), strip(F.col("r.target_entity"))
    return rows.where((source != "") & (target != "")).select(
        "chunk_id", F.col("pos").cast("bigint").alias("pos"), source.alias("source_entity"), target.alias("target_entity"),
        relation_type(F.col("r.relation_type")).alias("relation_type"), F.coalesce("r.description", F.lit("")).alias("description"),
        unit_weight(F.col("r.weight")).alias("weight"),
    )


def tuple_mentions(replies: DataFrame, between: str = "<|>", record: str = "##", done: str = "<|COMPLETE|>") -> DataFrame:
    """``chunk_id, pos, fields``: the records of a reply in delimited tuples; the first field is the kind of record."""
    text = F.replace(F.col("reply"), F.lit(done), F.lit(""))
    rows = replies.select("chunk_id", F.posexplode(F.split(text, rf"\Q{record}\E")).alias("pos", "r"))
    bare = F.regexp_replace(strip(F.col("r")), r"^\(|\)\z", "")
    fields = F.transform(F.split(bare, rf"\Q{between}\E"), lambda x: F.regexp_replace(strip(x), r"^\"|\"\z", ""))
    return rows.where(bare != "").select("chunk_id", "pos", fields.alias("fields"))
