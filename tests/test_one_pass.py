"""Chunking in one pass equals the composition of its steps; equal files are one document."""

import random

from pyspark.sql import functions as F

from graphweave.functions.text import token_count
from graphweave.operators import chunking, validate
from graphweave.plans import pipeline


def composed(documents, size, overlap):
    parts = chunking.prefixed(chunking.sections(documents, "file_hash"))
    rows = chunking.packed(chunking.units(parts, "file_hash"), size, overlap, "file_hash")
    rows = rows.join(parts.select("file_hash", "section_no", "heading_hierarchy", "start_char"), ["file_hash", "section_no"])
    rows = rows.join(documents.select("file_hash", F.col("text").alias("whole")), "file_hash")
    found = F.expr("locate(substring(first_unit, 1, 50), whole, start_char + 1)")
    start = F.when(found > 0, found - 1).otherwise(F.col("start_char")).cast("int")
    return rows.select("file_hash", "section_no", "part_no", "text", token_count(F.col("text")).alias("n"), start.alias("start"), "heading_hierarchy")


def test_one_pass_equals_the_steps(spark):
    draw = random.Random(6)
    pieces = ["# One", "## Two  ", "###Three", "\t#### Four \x85x", "", "A plain sentence. And Another! Yes?  No.", "| a | b |", "| c | d |", "word " * 40, "Ünï\u2003Code ❤ 日本. Ok", "\u00a0", "x\x0by", "####### none", "# a\rb", "a.\u2028B"]
    texts = ["\n".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25))) for _ in range(120)] + ["", " ", None, "# only", "x" * 3000, "word " * 3000]
    df = spark.createDataFrame([(f"{i:064d}", t, "c") for i, t in enumerate(texts)], "file_hash string, text string, chunk_id string")
    for size, overlap in ((12, 4), (512, 64)):
        expect = sorted(tuple(r) for r in composed(df, size, overlap).collect())
        found = chunking.chunk(df, size, overlap).orderBy("file_hash", "chunk_index").collect()
        assert [(r.file_hash, r.text, r.token_count, r.start_char, r.heading_hierarchy) for r in found] == [(r[0], *r[3:]) for r in expect]
        assert all(r.end_char == r.start_char + len(r.text) for r in found) and len({r.chunk_id for r in chunking.chunk(df, size, overlap, id_width=64).collect()}) == len(found)
    rows = chunking.chunk(df, 12, 4)
    one, other = (validate.judged(x, 3).select("chunk_index", "file_hash", "reasons").collect() for x in (rows, rows.drop("repeated")))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and any(r.reasons == ["duplicate"] for r in one)
    assert chunking.chunk(df.limit(0)).count() == 0


def test_equal_files_are_one_document(spark):
    text = "\n".join(f"Line {i} has a few words of plain prose in it and ends here." for i in range(80))
    rows = [("a" * 64, text, "one.md"), ("a" * 64, text, "copy.md"), ("b" * 64, text + " More.", "two.md"), ("c" * 64, None, "none.md")]
    df = spark.createDataFrame(rows, "file_hash string, text string, source_file string")
    tables = pipeline.ingest_chunks(df)
    chunks = tables["chunks"].collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) and {c.file_hash[0] for c in chunks} == {"a", "b"}
    own = sorted((c for c in chunks if c.file_hash[0] == "a"), key=lambda c: c.chunk_index)
    assert own[0].text.startswith("Line 0 has a few words of plain prose in it and ends here.\nLine 1 ")
    assert tables["documents"].count() == 3 and {tuple(r) for r in tables["sources"].collect()} == {(h, s) for h, _, s in rows}
    assert pipeline.each_file_once(df.where("source_file != 'copy.md'")).count() == 3 == pipeline.each_file_once(df).count()


def test_no_shuffle(spark):
    df = spark.createDataFrame([("a" * 64, "text")], "file_hash string, text string")
    plan = validate.valid(chunking.chunk(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
