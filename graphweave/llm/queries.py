"""The registered queries of the numbered problems: each runs its operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import confusables, language, leakage, names, neighbours, ocr, splitting, tokenizer
from graphweave.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.same_names(table(spark, sf, "entities"), table(spark, sf, "relationships"))


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every entity row that names a person or an organisation."""
    return names.linked(table(spark, sf, "entities"), table(spark, sf, "relationships"))[0]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.wrong_languages(table(spark, sf, "documents"), table(spark, sf, "document_metadata"), table(spark, sf, "lang_samples"))


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The language and confidence of every document and of each paragraph in another language."""
    profiles = language.fit_profiles(table(spark, sf, "lang_samples"))
    found = language.document_languages(table(spark, sf, "documents"), profiles)
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "letters").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf, "entities"))


def p3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five closest others, with similarity and rank, of every entity."""
    return neighbours.nearest(table(spark, sf, "entities"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized_ids(table(spark, sf, "chunks"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of the oversized chunks."""
    return splitting.pieces(table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.noise(table(spark, sf, "chunks"), table(spark, sf, "document_metadata"))


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired text of every chunk."""
    return ocr.repaired(table(spark, sf, "chunks"), table(spark, sf, "document_metadata"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of the documents that hold no evaluation item."""
    return leakage.clean(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All verbatim matches of more words than shared wording has, with their places."""
    return leakage.matches(table(spark, sf, "documents"), table(spark, sf, "eval_items")).where(f"words > {leakage.SHARED}")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.look_alike_pairs(table(spark, sf, "documents"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text."""
    return table(spark, sf, "documents").select("doc_id", confusables.skeleton_column(F.col("text")).alias("form"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of equal look of every document."""
    return confusables.classes(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}
