"""Text-cleaning projections. Every step is one column expression, so cleaning never shuffles; null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.text import WORD, WS, let, lines, nfkc, strip

# What the cleaning steps look for.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HYPHENATION = rf"({WORD}+)-\n({WORD}+)"
HEADER_FOOTER = rf"(?mid)^{WS}*(?:page{WS}+\p{{Nd}}+(?:{WS}+of{WS}+\p{{Nd}}+)?|confidential|draft|©.*\p{{Nd}}{{4}}){WS}*$"
PAGE_NUMBER = rf"(?md)^{WS}*\p{{Nd}}{{1,5}}{WS}*$"
REPEATS = 3


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def join_hyphenated(text: Column) -> Column:
    """Joins words broken over a line end; a rule of hyphens stays."""
    return F.regexp_replace(text, HYPHENATION, "$1$2")


def drop_headers(text: Column) -> Column:
    return F.regexp_replace(text, HEADER_FOOTER, "")


def drop_page_numbers(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_NUMBER, "")


def drop_repeated_lines(text: Column, most: int = REPEATS) -> Column:
    """Drops every line that occurs more than ``most`` times, blank lines excepted.

    A line is repeated if it stands ``most`` places further in the sorted lines as well: no shuffle, no nested loop.
    """


    def often(ordered: Column) -> Column:
        shifted = F.slice(ordered, most + 1, F.greatest(F.size(ordered), F.lit(1)))
        return F.array_distinct(F.filter(F.zip_with(ordered, shifted, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))

    def kept(every: Column) -> Column:
        ordered = F.array_sort(F.filter(F.transform(every, strip), lambda x: x != ""))
        without = lambda bad: F.when(F.size(bad) == 0, every).otherwise(F.filter(every, lambda x: ~F.array_contains(bad, strip(x))))
        return let(let(ordered, often), without)

    return F.array_join(let(lines(text), kept), "\n")


def tidy(text: Column) -> Column:
    """Single spaces, at most one blank line, then no blank lines, and no white space at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "\n{3,}", "\n\n")
    text = F.array_join(F.filter(lines(text), lambda x: strip(x) != ""), "\n")
    return strip(text)


def clean_composed(text: Column) -> Column:
    """All steps in their order but the first, compatibility composition."""
    text = F.translate(join_hyphenated(drop_control(text)), "\t", " ")
    return tidy(drop_repeated_lines(drop_page_numbers(drop_headers(text))))


def clean(documents: DataFrame) -> DataFrame:
    """``documents`` with the cleaned ``text``; composition comes as a column of its own, since it may need Python."""
    return documents.withColumn("text", nfkc(F.col("text"))).withColumn("text", clean_composed(F.col("text")))
