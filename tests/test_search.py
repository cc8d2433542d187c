import numpy as np
from pyspark.sql import functions as F

from graphweave.operators import context, search
from graphweave.plugins import answers, embed, with_retries


def test_keywords_and_intent(spark):
    df = spark.createDataFrame([("What is web scraping?",), ("Which country is largest?",), ("",), (None,)], "q string")
    rows = df.select(search.keywords(F.col("q")).alias("k"), search.intent(F.col("q")).alias("i")).collect()
    assert rows[0].k == ["web", "scraping", "web scraping"] and rows[0].i == "exploratory"
    assert rows[1].i == "aggregation" and rows[2].k == [] and rows[3].k is None


def test_vector_top_k_is_brute_force(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(40, 8)).round(2)
    vectors[7] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [1.0])]
    entities = spark.createDataFrame(rows, "entity_id long, embedding array<double>")
    questions = entities.where("entity_id % 10 = 0").withColumnRenamed("entity_id", "question_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = search.vector_top_k(questions, entities, 3).collect()
    for q in (0, 10, 20, 30):
        scores = np.round(unit @ unit[q], 6)
        assert sorted(r.entity_id for r in found if r.question_id == q) == sorted(sorted(range(40), key=lambda i: (-scores[i], i))[:3])
    assert search.vector_top_k(questions.limit(0), entities.limit(0), 3).count() == 0


def test_matches_and_fusion(spark):
    entities = spark.createDataFrame([("Web Server", ["WS"], "serves"), ("Other", None, "a web thing"), ("Third", [], None)], "name string, aliases array<string>, description string")
    asked = spark.createDataFrame([(1, "ws"), (1, "web server")], "question_id long, wanted string")
    exact = search.exact_matches(asked, entities)
    assert [tuple(r) for r in exact.collect()] == [(1, "Web Server", 1.0)]
    words = spark.createDataFrame([(1, "WEB"), (1, "zz"), (1, "x")], "question_id long, keyword string")
    fuzzy = search.fuzzy_matches(words, entities)
    assert {r["name"] for r in fuzzy.collect()} == {"Web Server", "Other"}
    vector = spark.createDataFrame([(1, "Web Server", 0.9)], "question_id long, name string, score double")
    scores = {r["name"]: r.combined_score for r in search.fused(exact.union(fuzzy), vector).collect()}
    assert scores == {"Web Server": 0.96, "Other": 0.42}


def test_traversal(spark):
    seeds = spark.createDataFrame([(1, "a")], "question_id long, name string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "d"), ("a", "a")], "source_entity string, target_entity string")
    assert {r["name"] for r in search.neighbours(seeds, edges).collect()} == {"b", "c"}
    assert search.incident_edges(seeds, edges).count() == 3
    links = spark.createDataFrame([("x", "y"), ("y", "z")], "current_chunk_id string, next_chunk_id string")
    found = spark.createDataFrame([(1, "y"), (1, "z")], "question_id long, chunk_id string")
    assert {(r.chunk_id, r.hop) for r in search.expanded_chunks(found, links).collect()} == {("y", 0), ("z", 0), ("x", 1)}


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 100), (1, 2, 5000), (1, 3, 50)], "question_id long, o int, tokens int")
    assert [r.o for r in context.within_budget(rows, ["o"], F.lit(200)).collect()] == [1]
    df = spark.createDataFrame([("one two, three",), ("",)], "t string")
    assert [r[0] for r in df.select(context.truncated(F.col("t"), 3)).collect()] == ["one two,", ""]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "What?", "The sky is blue. What is up")], "question_id long, question string, context string")
    assert answers(df).first().answer
    assert len(embed(df, "context").first().embedding) == 64
    calls = []
    assert with_retries(lambda p: calls.append(p) or "ok", least=0)("x") == "ok"
