import random

import pytest
from pyspark.sql import functions as F

from graphweave.errors import GraphConstructionError
from graphweave.operators import graph, mentions, resolve

ENTITY = "pos long, name string, type string, description string, aliases array<string>, source_chunk_ids array<string>"
EDGE = "pos long, source_entity string, target_entity string, relation_type string, description string, weight double, source_chunk_ids array<string>"


def test_reply_parsing(spark):
    good = '```json\n{"entities": [{"name": " Ada ", "type": "", "aliases": null}, {"name": " "}], "relationships": [{"source_entity": "Ada", "target_entity": "B", "relation_type": "works at", "weight": "8"}]}\n```'
    df = spark.createDataFrame([("c1", good), ("c2", "no json"), ("c3", None)], "chunk_id string, reply string")
    assert [tuple(r) for r in mentions.entity_mentions(df).collect()] == [("c1", 0, "Ada", "CONCEPT", "", [])]
    row = mentions.relationship_mentions(df).first()
    assert (row.relation_type, row.weight) == ("WORKS_AT", 0.8)
    tuples = spark.createDataFrame([("c", '("entity"<|>"A"<|>"T")##("relationship"<|>"A"<|>"B")<|COMPLETE|>')], "chunk_id string, reply string")
    assert [r.fields for r in mentions.tuple_mentions(tuples).collect()] == [["entity", "A", "T"], ["relationship", "A", "B"]]


def test_failed_extraction_is_a_row(spark):
    def extractor(key, text):
        if text == "bad":
            raise ValueError("no")
        return "{}"

    df = spark.createDataFrame([("a", "ok"), ("b", "bad")], "chunk_id string, text string")
    assert {(r.chunk_id, r.error) for r in mentions.extract(df, extractor).collect()} == {("a", None), ("b", "no")}


def test_grouping_and_mutual_aliases(spark):
    rows = [
        (1, "Alpha", "ORG", "short", ["Beta"], ["c2"]), (2, "alpha", "ORG", "a longer text", None, ["c1"]), (3, "Alpha", "X", None, [], None),
        (4, "Beta", "ORG", "", ["Alpha"], ["c3"]), (5, None, "X", "", None, None), (6, "Gamma", None, None, None, None),
    ]
    found = resolve.grouped(spark.createDataFrame(rows, ENTITY))
    alpha = found.where("key = 'alpha'").first()
    assert (alpha["name"], alpha["type"], alpha["description"], alpha["aliases"], alpha["source_chunk_ids"]) == ("Alpha", "ORG", "a longer text", ["Beta", "alpha"], ["c1", "c2"])
    merged = {r["name"]: r for r in resolve.merged(found).collect()}
    assert set(merged) == {"Alpha", "Gamma"} and merged["Alpha"]["source_chunk_ids"] == ["c1", "c2", "c3"]
    assert {r.key for r in resolve.type_conflicts(spark.createDataFrame(rows, ENTITY)).collect()} == {"alpha"}


def test_components_of_a_long_chain(spark):
    names = [f"n{i:03d}" for i in range(60)]
    links = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    assert {(r.component) for r in resolve.components(links).collect()} == {"n000"}


def test_fold_is_the_sequential_mean(spark):
    draw = random.Random(1)
    rows = [(1, "a", "b", "R", "x", 0.2, ["c"]), (2, "a", "b", "R", "yy", 0.4, ["d"]), (3, "a", "b", "R", "zz", 1.0, None)]
    many = [draw.random() for _ in range(150)]
    rows += [(i, "p", "q", "R", None, w, None) for i, w in enumerate(many)]
    found = {r.source_entity: r for r in resolve.folded(spark.createDataFrame(rows, EDGE), ["pos"]).collect()}
    assert found["a"].weight == pytest.approx(0.65) and found["a"].description == "yy" and found["a"].source_chunk_ids == ["c", "d"]
    mean = many[0]
    for w in many[1:]:
        mean = (mean + w) / 2
    assert found["p"].weight == pytest.approx(mean, abs=1e-12) and found["p"].mentions == 150


def test_remap_drop_and_orphans(spark):
    entities = resolve.grouped(spark.createDataFrame([(1, "Alpha", "T", "", ["Al"], None), (2, "Beta", "T", "", None, None), (3, "Lone", "T", "", None, None)], ENTITY))
    edges = spark.createDataFrame([(1, "AL", "beta", "R", "", 1.0, None), (2, "Alpha", "al", "R", "", 1.0, None), (3, "Alpha", "Nobody", "R", "", 1.0, None)], EDGE)
    mapped = resolve.remapped(edges, resolve.surface_forms(entities))
    kept = resolve.connected(mapped, entities)
    assert [(r.source_entity, r.target_entity) for r in kept.collect()] == [("Alpha", "Beta")]
    assert [r.pos for r in resolve.dangling(mapped, entities).collect()] == [3]
    assert [r["name"] for r in resolve.orphans(entities, kept).collect()] == ["Lone"]


def test_next_chunk_skips_gaps_and_upsert(spark):
    df = spark.createDataFrame([("f", "f_0", 0), ("f", "f_2", 2), ("f", "f_5", 5), ("f", "f_x", None), ("g", "g_0", 0)], "file_hash string, chunk_id string, chunk_index int")
    assert {tuple(r) for r in graph.next_chunk(df).collect()} == {("f_0", "f_2"), ("f_2", "f_5")}
    old = spark.createDataFrame([("k", 1, "old"), ("l", 1, "kept")], "k string, seq int, v string")
    new = spark.createDataFrame([("k", 2, "new"), ("k", 2, "new")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in graph.upsert(old, new, ["k"], "seq").collect()} == {("k", "new"), ("l", "kept")}
    with pytest.raises(GraphConstructionError):
        graph.check_key(new, ["k"])


def test_typed_edges_collapse(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "name string")
    edges = spark.createDataFrame([(1, "a", "b", "works-at", "x", 0.1, None), (2, "a", "b", "WORKS AT", "y", 0.2, None), (3, "a", "z", "R", "", 0.1, None)], EDGE)
    assert [tuple(r) for r in graph.typed_edges(edges, entities, ["pos"]).collect()] == [("a", "WORKS_AT", "b", "y", 0.2)]


def test_counts_and_provenance(spark):
    entities = spark.createDataFrame([("a", ["c1", "c1", "cx"]), ("b", None)], "name string, source_chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "f")], "chunk_id string, file_hash string")
    assert [tuple(r) for r in graph.extracted_from(entities, chunks).collect()] == [("a", "c1")]
    assert {tuple(r) for r in graph.node_counts(A=entities, B=chunks.where(F.lit(False))).collect()} == {("A", 2), ("B", 0)}


def test_fold_keeps_what_a_double_keeps(spark):
    rows = [("a", "b", "T", 1.0, "d", i, None) for i in range(1)] + [("a", "b", "T", 0.0, "", i, None) for i in range(1, 100)]
    edges = spark.createDataFrame(rows, "source_entity string, target_entity string, relation_type string, weight double, description string, pos long, source_chunk_ids array<string>")
    row = resolve.folded(edges, ["pos"]).first()
    assert row.weight == 0.5**99 and row.mentions == 100 and row.description == "d" and row.arrived.pos == 99


def test_resolved_entities_keep_every_mention(spark):
    rows = [(1, "Flow Meter", "T", "", ["FM"], ["c1"], None), (2, "flow meter", "T", "long text", None, ["c2"], [1.0]), (3, "FM", "T", "", None, ["c3"], [2.0])]
    found = resolve.merged(resolve.grouped(spark.createDataFrame(rows, "pos long, name string, type string, description string, aliases array<string>, source_chunk_ids array<string>, embedding array<double>"))).collect()
    assert len(found) == 1 and found[0]["name"] == "Flow Meter" and found[0].mentions == 3 and found[0].embedding == [1.0]
    assert found[0].source_chunk_ids == ["c1", "c2", "c3"] and set(found[0].aliases) == {"FM", "flow meter"}
