from pyspark.sql import functions as F

from graphweave.functions import text as T
from graphweave.operators import context


def test_contexts_end_at_the_budget(spark):
    hits = spark.createDataFrame([(1, "Hub", "T", "a hub", 1.0), (2, "Lone", "T", "", 1.0)], "question_id long, name string, type string, description string, combined_score double")
    edges = spark.range(3000).select(F.lit(1).cast("long").alias("question_id"), F.lit("Hub").alias("source_entity"), F.lit("R").alias("label"), F.format_string("n%04d", "id").alias("target_entity"), F.lit("told").alias("description"))
    chunks = spark.createDataFrame([(q, "c", "some text", "f", 0) for q in (1, 2)], "question_id long, chunk_id string, text string, source_file string, hop int")
    whole = "=== RELEVANT ENTITIES ===\n- Hub (T): a hub\n\n=== KEY RELATIONSHIPS ===\n" + "\n".join(f"- Hub --[R]--> n{i:04d}: told" for i in range(3000))
    for budget in (40, 2500):
        rows = {r.question_id: r for r in context.contexts(hits, edges, chunks, budget).collect()}
        cut = rows[1].context
        assert rows[1].tokens == budget and whole.startswith(cut)
        assert spark.createDataFrame([(cut,)], "t string").select(T.token_count(F.col("t"))).first()[0] == budget
        assert rows[2].tokens == (31 if budget == 40 else 43) and rows[2].context.endswith("some text") == (budget == 2500)


def test_lines_beyond_the_budget_are_cut_before_the_shuffle(spark):
    edges = spark.range(3000).select((F.col("id") % 2).alias("question_id"), F.lit("Hub").alias("source_entity"), F.lit("R").alias("label"), F.format_string("n%04d", "id").alias("target_entity"), F.lit("").alias("description"))
    assert [r.edge_section.count("\n") for r in context.edge_section(edges, 100).collect()] == [10, 10]
    assert "WindowGroupLimit" in context.edge_section(edges)._jdf.queryExecution().executedPlan().toString()
