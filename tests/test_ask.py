from graphweave.operators import search
from graphweave.plans import pipeline

ENTITY = "entity_id long, name string, type string, description string, aliases array<string>, source_chunk_ids array<string>, embedding array<double>"


def test_keywords_of_questions_find_entities_without_vectors(spark):
    entities = spark.createDataFrame(
        [(1, "Flow Meter", "T", "measures", None, ["c1"], None), (2, "Crew", "P", "reads a meter", None, None, [0.0, 1.0]), (3, "Pump", "T", "", None, None, [1.0, 0.0])], ENTITY
    )
    questions = spark.createDataFrame([(1, "What is the Meter?", [1.0, 0.0]), (2, "What is the flow?", None), (3, "Who?", None)], "question_id long, question string, embedding array<double>")
    edges = spark.createDataFrame([("Crew", "USES", "Pump", "")], "source_entity string, label string, target_entity string, description string")
    chunks = spark.createDataFrame([("c1", "Flow text", "f")], "chunk_id string, text string, source_file string")
    links = spark.createDataFrame([], "current_chunk_id string, next_chunk_id string")
    found = {r.question_id: r.context for r in pipeline.ask(questions, entities, edges, chunks, links).collect()}
    assert "- Flow Meter (T): measures" in found[1] and "- Pump (T): " in found[1]
    assert found[2] == (
        "=== RELEVANT ENTITIES ===\n- Flow Meter (T): measures\n\n=== KEY RELATIONSHIPS ===\n\n"
        "=== RELEVANT TEXT PASSAGES ===\n\n[Chunk c1] (Source: f):\nFlow text"
    )
    assert found[3] == "=== RELEVANT ENTITIES ===\n\n=== KEY RELATIONSHIPS ===\n\n=== RELEVANT TEXT PASSAGES ==="


def test_fuzzy_match_keeps_the_first_of_all_keywords(spark):
    entities = spark.createDataFrame([(f"n{i:02d}", f"{'even' if i % 2 == 0 else 'odd'} {'late' if i > 6 else ''}") for i in range(12)], "name string, description string")
    asked = spark.createDataFrame([(1, "odd"), (1, "late"), (2, "even")], "question_id long, keyword string")
    found = search.fuzzy_matches(asked, entities, 4).collect()
    assert {q: sorted(r["name"] for r in found if r.question_id == q) for q in (1, 2)} == {1: ["n01", "n03", "n05", "n07"], 2: ["n00", "n02", "n04", "n06"]}
