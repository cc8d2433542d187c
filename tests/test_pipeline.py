import json
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from graphweave import cli, plugins
from graphweave.config import EngineConfig
from graphweave.errors import DocumentLoadError
from graphweave.plans import pipeline
from graphweave.sources import files
from graphweave.streaming import ingest

PROSE = "The crew measures the flow in every pipe. " * 12


@pytest.fixture()
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text(f"# Flow Metering\n{PROSE}\n\n## Limits\n{PROSE}\n", encoding="utf-8")
    (source / "B.MD").write_text(" ", encoding="utf-8")
    (source / "c.pdf").write_bytes(b"broken")
    return source


def test_markdown_to_chunks_and_back(spark, folder, tmp_path):
    read = files.read_markdown(spark, str(folder))
    assert {(r.source_file, bool(r.text)) for r in read.collect()} == {("a.md", True), ("B.MD", True)}
    tables = pipeline.ingest_chunks(read, EngineConfig(chunk_size_tokens=60, chunk_overlap_tokens=10))
    files.write_tables(tables, str(tmp_path / "out"))
    back = files.read_tables(spark, str(tmp_path / "out"), ["documents", "chunks", "part_of", "next_chunk"])
    chunks = back["chunks"].orderBy("chunk_index").collect()
    assert len(chunks) > 2 and chunks[0].text.startswith("[Flow Metering]") and all(c.token_count <= 61 for c in chunks)
    assert back["part_of"].count() == len(chunks) and back["next_chunk"].count() == len(chunks) - 1
    assert back["documents"].where("source_file = 'a.md'").first().title == "Flow Metering"
    found = json.loads(files.chunks_json(back["documents"], back["chunks"]).where("json like '%a.md%'").first().json)
    assert found["total_chunks"] == len(chunks) and found["chunks"][0]["chunk_index"] == chunks[0].chunk_index


def test_full_ingest(spark, folder):
    reply = {
        "entities": [{"name": "Flow Meter", "type": "TECHNOLOGY", "aliases": ["Meter"]}, {"name": "flow meter"}, {"name": "Crew"}],
        "relationships": [{"source_entity": "crew", "target_entity": "Meter", "relation_type": "uses", "weight": 7}],
    }

    def extractor(key, text):
        if key.endswith("0001"):
            raise OSError("down")
        return json.dumps(reply)

    read = files.read_markdown(spark, str(folder)).where("source_file = 'a.md'")
    tables = pipeline.ingest(read, extractor)
    assert {r["name"] for r in tables["entities"].collect()} == {"Flow Meter", "Crew"}
    edge = tables["edges"].first()
    assert (edge.source_entity, edge.label, edge.target_entity, round(edge.weight, 6)) == ("Crew", "USES", "Flow Meter", 0.7)
    assert tables["replies"].where("error = 'down'").count() == 1 and tables["extracted_from"].count() == 2
    assert all(len(r.embedding) == 64 for r in tables["entity_nodes"].collect())


def test_pdf_needs_a_converter(spark, folder):
    with pytest.raises(DocumentLoadError):
        files.read_pdf(spark, str(folder))

    def convert(content):
        raise OSError("broken")

    row = files.read_pdf(spark, str(folder), convert).first()
    assert row.error == "broken" and row.text == ""


def test_command_line(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "graph")
    assert cli.main(["ingest-chunks", str(folder), out, "--clear-graph"]) == 0
    assert cli.main(["query", "What is flow metering?", out]) == 0
    assert "Flow Metering" in capsys.readouterr().out


def _broken(prompt):
    raise OSError("no answer")


def test_command_line_with_entities(spark, tmp_path, capsys, monkeypatch):
    folder, out = tmp_path / "docs", str(tmp_path / "graph")
    folder.mkdir()
    body = "The Flow Meter belongs to the North Station and is read by the crew of the night shift every morning before the handover begins. "
    (folder / "a.md").write_text("# Flow Metering\n" + body * 4)
    (folder / "copy.md").write_text("# Flow Metering\n" + body * 4)
    assert cli.main(["ingest", str(folder), out, "--clear-graph", "--json"]) == 0
    assert "1 chunks" in capsys.readouterr().out
    assert {r["name"] for r in spark.read.parquet(f"{out}/entity_nodes").collect()} >= {"Flow Metering", "North Station"}
    assert spark.read.parquet(f"{out}/chunk_nodes").first().summary and spark.read.parquet(f"{out}/sources").count() == 2
    assert spark.read.json(f"{out}/relationships_json").count() >= 1 and spark.read.text(f"{out}/chunks_json").count() == 1
    assert cli.main(["query", "Where is the Flow Meter?", out]) == 0
    shown = capsys.readouterr().out
    assert "The Flow Meter belongs" in shown and "=== KEY RELATIONSHIPS ===\n- The Flow Meter --[RELATED_TO]--> North Station" in shown
    (tmp_path / "questions.txt").write_text("What is the North Station?\n\nWhat is the North Station?\nWho reads it?\n")
    assert cli.main(["qa", out, str(tmp_path / "questions.txt")]) == 0
    rows = spark.read.parquet(f"{out}/answers").collect()
    assert len(rows) == 2 and all(r.answer and r.error is None for r in rows)
    assert cli.main(["query", "x", str(tmp_path / "none")]) == 1


def test_failed_answers_stay_with_their_question(spark):
    contexts = spark.createDataFrame([(1, "q", "c")], "question_id long, question string, context string")
    row = plugins.answers(contexts, plugins.with_retries(_broken, 2, 0.0)).first()
    assert row.answer is None and row.error == "no answer"


def test_settings(monkeypatch):
    monkeypatch.setenv("CHUNK_SIZE_TOKENS", "100")
    monkeypatch.setenv("TOP_K", "0")
    config = EngineConfig.from_environment()
    assert config.chunk_size_tokens == 100 and config.top_k == 10 and EngineConfig.full_ingest().chunk_overlap_tokens == 80
    with pytest.raises(ValueError):
        EngineConfig(chunk_size_tokens=10, chunk_overlap_tokens=10)


def test_stream_upserts(spark, tmp_path):
    rows = [("f1", "text one", datetime(2025, 1, 1)), ("f1", "text one", datetime(2025, 1, 1)), ("f2", "text two", datetime(2025, 1, 2))]
    spark.createDataFrame(rows, "file_hash string, text string, ingested_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_hash string, text string, ingested_at timestamp").parquet(str(tmp_path / "in"))
    done = ingest.upsert_stream(ingest.stream_documents(stream), str(tmp_path / "out"), str(tmp_path / "cp"), ["file_hash"], "ingested_at")
    done.awaitTermination(120)
    assert ingest.read_latest(spark, str(tmp_path / "none")) is None
    assert ingest.read_latest(spark, str(tmp_path / "out")).count() == 2
    # a stream with a new checkpoint goes on from the last version
    more = spark.createDataFrame([("f3", "text three", datetime(2025, 1, 3))], "file_hash string, text string, ingested_at timestamp")
    more.write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema("file_hash string, text string, ingested_at timestamp").parquet(str(tmp_path / "in2"))
    ingest.upsert_stream(ingest.stream_documents(stream), str(tmp_path / "out"), str(tmp_path / "cp2"), ["file_hash"], "ingested_at").awaitTermination(120)
    assert ingest.read_latest(spark, str(tmp_path / "out")).count() == 3 and ingest.finished(spark, str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("name", ["doc_sha256", "sections", "sentences", "entity_group", "edge_fold", "typed_edges", "fuzzy_match", "vector_topk", "next_chunk"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in "documents document_metadata chunks entities relationships events".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expect = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in row]) for row in result.fetchall())
    rows = __spark_entry__.queries()[name](spark, sf).select(*names).collect()
    assert sorted(repr([round(v, 6) if isinstance(v, float) else v for v in row]) for row in rows) == expect
