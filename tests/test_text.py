from pyspark.sql import functions as F

from graphweave.functions import text as T
from graphweave.operators import clean, metadata


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first().x


def test_hyphenation_keeps_rules(spark):
    assert one(spark, clean.join_hyphenated, "knowl-\nedge --\n---") == "knowledge --\n---"


def test_repeated_lines_more_than_three(spark):
    text = "X\nY\nX\nY\nX\nY\n X "
    assert one(spark, clean.drop_repeated_lines, text) == "Y\nY\nY"
    assert one(spark, clean.drop_repeated_lines, "") == ""
    assert one(spark, clean.drop_repeated_lines, None) is None


def test_headers_and_page_numbers(spark):
    assert one(spark, clean.drop_headers, "Page 3 of 9\nCONFIDENTIAL\nPage three").strip() == "Page three"
    assert one(spark, clean.drop_page_numbers, "12\n123456").strip() == "123456"


def test_clean_composes_and_tidies(spark):
    df = spark.createDataFrame([("ﬁne\ttext  here\n\n\n\x07end ", 1), (None, 2), ("", 3)], "text string, extra int")
    assert [r.text for r in clean.clean(df).orderBy("extra").collect()] == ["fine text here\nend", None, ""]


def test_titles(spark):
    assert one(spark, metadata.inferred_title, "## Sub\n# Main Title\ntext") == "Main Title"
    assert one(spark, metadata.inferred_title, "<!-- image -->\n## First") == "First"
    assert one(spark, metadata.inferred_title, "") is None
    assert one(spark, metadata.inferred_title, None) is None


def test_language_vote(spark):
    assert one(spark, metadata.voted_language, "das ist die Sache mit der Uhr") == "de"
    assert one(spark, metadata.voted_language, "xyz") == "en"


def test_names_labels_weights(spark):
    for raw, key in [("C++", "c"), ("C#", "c"), ("R&D", "rd"), ("Open-Source  Initiative", "open-source initiative"), (None, None)]:
        assert one(spark, T.name_key, raw) == key
    for raw, label in [("works-at!!", "WORKS_AT"), ("---", "RELATED_TO"), (None, "RELATED_TO")]:
        assert one(spark, T.safe_label, raw) == label
    for raw, weight in [("8", 0.8), ("1", 1.0), ("0.85", 0.85), ("15", 1.0), ("-1", 0.0), ("high", 0.8), (None, 0.8)]:
        assert one(spark, T.unit_weight, raw) == weight


def test_current_metadata_takes_the_last(spark):
    rows = [("f", "a", "2024-01-01"), ("f", "b", "2024-01-02"), ("g", None, "2024-01-01")]
    df = spark.createDataFrame(rows, "file_hash string, language string, ingested_at string")
    assert {(r.file_hash, r.language) for r in metadata.current_rows(df).collect()} == {("f", "b"), ("g", None)}
