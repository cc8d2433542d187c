"""Column functions on text that all operators share. Null in, null out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space, word characters and digits as sets that Java and RE2 both read as Unicode.
WS = r"[\s\x0B\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: The default token: a run of word characters or one other character that is not white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` or a lambda in it refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def word_count(text: Column) -> Column:
    """The number of runs of other characters than white space."""
    return F.regexp_count(text, F.lit(r"[^\s\x0B\x{85}\p{Z}]+"))


def token_count(text: Column) -> Column:
    """The number of default tokens."""
    return F.regexp_count(text, F.lit(TOKEN))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; plain ASCII stays in the JVM."""
    plain = text.rlike(r"^[\x00-\x7F]*\z")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def name_key(name: Column) -> Column:
    """A name in lower case, stripped, without marks other than hyphens, and with single spaces."""
    plain = F.regexp_replace(strip(F.lower(name)), r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}-]", "")
    return F.regexp_replace(plain, rf"{WS}+", " ")


def safe_label(label: Column) -> Column:
    """An edge label of letters, digits and single underscores; RELATED_TO if nothing is left or the label is null."""
    marked = F.regexp_replace(F.upper(strip(label)), r"[^A-Za-z0-9_]", "_")
    bare = F.regexp_replace(F.regexp_replace(marked, "_+", "_"), r"^_|_\z", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("RELATED_TO"))


def relation_type(kind: Column) -> Column:
    """A relation type in upper case with underscores for spaces; RELATED_TO for null or blank."""
    bare = F.replace(F.upper(strip(kind)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("RELATED_TO"))


def unit_weight(weight: Column) -> Column:
    """A weight in [0, 1]: above 1 it is on a scale of ten, missing or no number is 0.8."""
    number = F.coalesce(weight.try_cast("double"), F.lit(0.8))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(number > 1, number / 10).otherwise(number)))
