"""Texts that look the same but differ in their characters (problem 8).

Null texts have a null skeleton and blank texts an empty one; neither takes part in groups or pairs. Repeated rows of
one document count once. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphweave.llm.textnorm import PLAIN, load_confusables, skeleton
from graphweave.session import checkpointed, spread

#: Rows of a class or text that meet in one task.
MOST_TOGETHER = 100_000


@F.arrow_udf(StringType())
def _skeleton_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([skeleton(x) for x in batch.to_pylist()], pa.string())


def skeleton_column(text: Column) -> Column:
    """The consistent form of ``text``. Plain ASCII stays in the JVM, only other texts go through Python."""
    blank = F.when(text.rlike(r"[!-~]"), text).otherwise(F.lit(""))
    return F.when(text.rlike(PLAIN), blank).otherwise(_skeleton_udf(F.when(~text.rlike(PLAIN), text)))


def skeletons(documents: DataFrame, table: str | None = None) -> DataFrame:
    """``doc_id, skeleton_hash, text_hash`` of every document with a visible character, each once.

    Both hashes are SHA-256, so equal hashes stand for equal texts and no text is shuffled. The rows are written to the
    checkpoint folder: the corpus is read once, whatever is done with them. ``table`` is a path to a public list of
    confusables that counts beside the built-in one; every task reads it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = load_confusables(table) if table else None
        for batch in batches:
            ids, looks, own = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                look = skeleton(text, more)
                if look:
                    ids.append(doc)
                    looks.append(sha256(look.encode("utf-8", "surrogatepass")).digest())
                    own.append(looks[-1] if look == text else sha256(text.encode("utf-8", "surrogatepass")).digest())
            columns = [pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "skeleton_hash", "text_hash"])

    rows = spread(documents.where("text is not null").select("doc_id", "text"))
    return checkpointed(rows.mapInArrow(work, "doc_id bigint, skeleton_hash binary, text_hash binary")).distinct()


def _hot(counted: DataFrame, key: str, rows: int) -> DataFrame:
    """``key, parts``: the keys of so many rows that they must not meet in one task. Such keys have at least a thousandth of
    all ``rows``, so that there are at most a thousand of them and they can be broadcast."""
    least = max(MOST_TOGETHER, rows // 1000)
    return F.broadcast(counted.where(F.col("n") > least).select(key, F.ceil(F.col("n") / MOST_TOGETHER).cast("int").alias("parts")))


def _parted(df: DataFrame, hot: DataFrame, key: str, by: str | None) -> DataFrame:
    """``df`` with the ``part`` of its key that a row is in (by the hash of a column), or with a row for every part."""
    parts = F.coalesce("parts", F.lit(1))
    part = F.explode(F.sequence(F.lit(0), parts - 1)) if by is None else F.pmod(F.hash(by), parts)
    return df.join(hot, key, "left").withColumn("part", part).drop("parts")


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_texts``: each document's class of equal look, named by its smallest ``doc_id``.

    ``class_texts`` is the number of different texts in the class; above 1 the class holds texts that only look equal.
    Copies are counted before the shuffle, and the rows of a class of a third of all rows are joined in parts.
    """
    rows = skeletons(documents)
    per_text = rows.groupBy("skeleton_hash", "text_hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    per_class = per_text.groupBy("skeleton_hash").agg(F.min("class_id").alias("class_id"), F.count("*").alias("class_texts"), F.sum("n").alias("n"))
    per_class = checkpointed(per_class)
    hot = _hot(per_class, "skeleton_hash", per_class.agg(F.sum("n").alias("n")).first().n or 0)
    held = _parted(rows, hot, "skeleton_hash", "doc_id").join(_parted(per_class, hot, "skeleton_hash", None), ["skeleton_hash", "part"])
    return held.select("doc_id", "class_id", "class_texts").distinct()


def look_alike_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``: every pair of documents that look the same and differ in a code point.

    Different texts of equal look are paired first; only then are both sides expanded to the documents that hold them.
    A group of mere copies never pairs with itself, however large it is; the documents of a text with many copies are
    joined in parts.
    """
    rows = skeletons(documents)
    texts = checkpointed(rows.groupBy("skeleton_hash", "text_hash").agg(F.count("*").alias("n")))
    mixed = texts.groupBy("skeleton_hash").agg(F.count("*").alias("texts")).where("texts > 1").select("skeleton_hash")
    held = checkpointed(rows.join(mixed, "skeleton_hash", "left_semi").select("doc_id", "text_hash"))
    texts = texts.join(mixed, "skeleton_hash", "left_semi")
    a = texts.select("skeleton_hash", F.col("text_hash").alias("hash_a"))
    b = texts.select("skeleton_hash", F.col("text_hash").alias("hash_b"))
    pairs = a.join(b, "skeleton_hash").where("hash_a < hash_b").select("hash_a", "hash_b")
    hot = _hot(texts.select("text_hash", "n"), "text_hash", held.count())
    for x, doc in (("hash_a", "doc_1"), ("hash_b", "doc_2")):
        own = hot.withColumnRenamed("text_hash", x)
        docs = held.select(F.col("text_hash").alias(x), F.col("doc_id").alias(doc))
        pairs = _parted(pairs, own, x, None).join(_parted(docs, own, x, doc), [x, "part"]).drop("part")
    return pairs.select(F.least("doc_1", "doc_2").alias("doc_id_a"), F.greatest("doc_1", "doc_2").alias("doc_id_b")).distinct()
