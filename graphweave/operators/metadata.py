"""Metadata projections: title, word count, language, hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import let, lines, strip, word_count

# The commonest small words of the languages that the vote tells apart.
SMALL_WORDS = {
    "de": "der die das und ist nicht mit den von auf",
    "en": "the and of to is in that for with on",
    "es": "el los las una por con para del que y",
    "fr": "le les des une est dans pour sur avec et",
    "it": "il gli una per con del che sono nel di",
    "nl": "de het een van en op voor met dat niet",
    "pl": "w i na z do nie się jest oraz po",
    "pt": "o os uma para com do da que em no",
    "ru": "и в на с по не для от из что",
}


def inferred_title(text: Column) -> Column:
    """The first top heading of 3 to 200 characters, else the first such line that is no comment; null if none."""
    stripped = F.transform(lines(text), strip)
    bare = lambda x: strip(F.regexp_replace(x, "^#+", ""))
    fits = lambda x: F.length(x).between(3, 200)
    top = F.filter(F.transform(F.filter(stripped, lambda x: x.startswith("# ")), bare), fits)
    other = F.filter(F.transform(stripped, bare), lambda x: fits(x) & ~x.startswith("<!--") & ~x.endswith("-->"))
    return F.coalesce(F.try_element_at(top, F.lit(1)), F.try_element_at(other, F.lit(1)))


def voted_language(text: Column) -> Column:
    """The language whose small words are most frequent among the first 2,000 characters' words; ``en`` if none occurs.
    Ties go to the first code in the alphabet. A baseline without a model; the profiles of the extension do better."""


    def best(start: Column) -> Column:
        votes = []
        for place, code in enumerate(sorted(SMALL_WORDS)):
            whole = rf"(?<!\p{{L}})(?:{SMALL_WORDS[code].replace(' ', '|')})(?!\p{{L}})"
            votes.append(F.struct(F.regexp_count(start, F.lit(whole)).alias("n"), F.lit(-place).alias("i"), F.lit(code).alias("code")))
        return F.greatest(*votes)

    top = let(F.lower(F.substring(text, 1, 2000)), best)
    return F.when(top["n"] > 0, top["code"]).otherwise("en")


def enrich(documents: DataFrame) -> DataFrame:
    """Adds ``title`` (kept where given), ``word_count``, ``language`` and ``text_hash``."""
    given = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    return documents.withColumns(
        {
            "title": F.coalesce(given, inferred_title(F.col("text"))), "word_count": word_count(F.col("text")),
            "language": voted_language(F.col("text")), "text_hash": F.sha2("text", 256),
        }
    )


def current_rows(metadata: DataFrame) -> DataFrame:
    """The current row of each file, the one that came last; ties go to the greatest row."""
    columns = [c for c in metadata.columns if c != "file_hash"]
    row = F.max_by(F.struct(*columns), F.struct("ingested_at", F.to_json(F.struct(*columns))))
    return metadata.groupBy("file_hash").agg(row.alias("row")).select("file_hash", "row.*")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
