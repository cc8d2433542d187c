import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweave.errors import ChunkingError
from graphweave.operators import chunking, validate


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_sections(spark):
    text = "intro\n# A\nx\n## B\ny\n# C\nz"
    rows = chunking.sections(docs(spark, text, None)).orderBy("section_no").collect()
    assert [(r.heading_hierarchy, r.body_text, r.start_char) for r in rows] == [([], "intro", 0), (["A"], "x", 6), (["A", "B"], "y", 12), (["C"], "z", 19)]


def test_units_keep_tables_whole(spark):
    text = "A. Foo bar! Baz? no. Qux\n| a. B |\n| c |\nEnd."
    rows = chunking.units(docs(spark, text).selectExpr("doc_id", "text", "0 AS section_no")).orderBy("unit_no").collect()
    assert [r.unit for r in rows] == ["A.", "Foo bar!", "Baz? no.", "Qux", "| a. B |\n| c |", "End."]


def test_pack_always_gets_on():
    assert chunking.pack([40, 480], 512, 64) == [(0, 1), (1, 2)]
    assert chunking.pack([10, 10, 10], 20, 10) == [(0, 2), (1, 3)]
    assert chunking.pack([], 20, 10) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40), st.data())
def test_pack_covers_all_units(tokens, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = chunking.pack(tokens, size, overlap)
    covered = set()
    for k, (a, b) in enumerate(spans):
        assert a < b and (b - a == 1 or sum(tokens[a:b]) <= size)
        assert k == 0 or (spans[k - 1][0] < a <= spans[k - 1][1] and b > spans[k - 1][1])
        covered |= set(range(a, b))
    assert covered == set(range(len(tokens)))


def test_chunk_ids_offsets_and_cutting(spark):
    text = "# T\n" + "word " * 30
    df = spark.createDataFrame([("abcdef0123456789", text)], "file_hash string, text string")
    rows = chunking.chunk(df, 10, 2).orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "abcdef012345_0000" and all(r.token_count <= 10 for r in rows)
    assert rows[0].text.startswith("[T]") and rows[-1].heading_hierarchy == ["T"]
    with pytest.raises(ChunkingError):
        chunking.chunk(df, 10, 10)


def test_rules(spark):
    rows = [
        ("a", "12345678ab", 50), ("b", "123456789a", 50), ("c", "[A > B]", 50), ("d", "prose here\ncontents of the page\nmore", 50),
        ("e", "fine text", 50), ("f", "fine text", 50), ("g", "short", 5), ("h", None, None), ("i", "[X]\nReferences", 50),
    ]
    df = spark.createDataFrame([("f1", k, i, t, n) for i, (k, t, n) in enumerate(rows)], "file_hash string, chunk_id string, chunk_index int, text string, token_count int")
    found = {r.chunk_id: r.reasons for r in validate.judged(df).collect()}
    assert found == {"a": [], "b": ["numeric"], "c": ["heading only"], "d": ["boilerplate"], "e": [], "f": ["duplicate"], "g": ["too short"], "h": ["too short"], "i": ["boilerplate"]}
    assert {r.chunk_id for r in validate.valid(df).collect()} == {"a", "e"}
    assert {r.reason: r.n for r in validate.reason_counts(df).collect()}["boilerplate"] == 2
