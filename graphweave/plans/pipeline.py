"""The engine's verbs as plans: ingest to chunks, build a graph, answer questions. Lazy but for components' rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.operators import chunking, clean, context, graph, mentions, metadata, resolve, search, validate
from graphweave.plugins import answers, embed, hashed_words
from graphweave.session import checkpointed, small, spread


def each_file_once(documents: DataFrame) -> DataFrame:
    """One row for each ``file_hash``, of equal files the smallest row. Only the hashes are shuffled, and of the texts those of
    files that have copies. Rows without a hash stay as they are."""
    counts = documents.where("file_hash is not null").groupBy("file_hash").agg(F.count("*").alias("n"))
    several = checkpointed(counts.where("n > 1").select("file_hash"))
    if several.isEmpty():
        return documents
    several = small(several)
    others = [c for c in documents.columns if c != "file_hash"]
    first = documents.join(several, "file_hash", "left_semi").groupBy("file_hash").agg(F.min(F.struct(*others)).alias("r"))
    return documents.join(several, "file_hash", "left_anti").unionByName(first.select("file_hash", "r.*"))


def ingest_chunks(documents: DataFrame, config: EngineConfig | None = None) -> dict[str, DataFrame]:
    """Documents (``file_hash, text``) to the tables of documents, chunks, PART_OF and NEXT_CHUNK.

    Equal files are one document; with a column ``source_file`` the table ``sources`` has the names of all of them."""
    config = config or EngineConfig()
    # written once: the chunks and the table of documents both start from the cleaned text
    cleaned = checkpointed(metadata.enrich(clean.clean(spread(each_file_once(documents)))))
    found = chunking.chunk(cleaned, config.chunk_size_tokens, config.chunk_overlap_tokens)
    kept = validate.valid(found, config.min_chunk_tokens)
    tables = {"documents": cleaned, "chunks": kept, "part_of": graph.part_of(kept, cleaned), "next_chunk": graph.next_chunk(kept)}
    if "source_file" in documents.columns:
        tables["sources"] = documents.select("file_hash", "source_file").distinct()
    return tables


def ingest(documents: DataFrame, extractor: Callable[[str, str], str], embedder: Callable[[str], list[float]] = hashed_words, config: EngineConfig | None = None) -> dict[str, DataFrame]:
    """The full ingest: chunks, an extractor's mentions, resolved and embedded entities, folded edges and the graph's tables.

    Replies are written to the checkpoint folder, so that no step asks the extractor twice. Chunks whose extraction failed
    stay, with their ``error`` in the table ``replies``. Mentions are ordered by document, chunk and place in the reply.
    """
    tables = ingest_chunks(documents, config or EngineConfig.full_ingest())
    chunks = checkpointed(tables["chunks"])
    replies = checkpointed(mentions.extract(chunks, extractor))
    place = chunks.select("chunk_id", "file_hash", "chunk_index")

    def ordered(found: DataFrame) -> DataFrame:
        found = found.join(place, "chunk_id").withColumn("pos", F.struct("file_hash", "chunk_index", "pos")).drop("file_hash", "chunk_index")
        return found.withColumn("source_chunk_ids", F.array("chunk_id"))

    graph_tables = resolve_graph(ordered(mentions.entity_mentions(replies)), ordered(mentions.relationship_mentions(replies)))
    entities = checkpointed(embed(resolve.embedding_text(graph_tables["entities"]), "embedding_text", embedder))
    edges = checkpointed(graph_tables["relationships"])
    tables |= {"chunks": chunks, "replies": replies, "entities": entities, "relationships": edges}
    summaries = replies.select("chunk_id", mentions.parse_reply(F.col("reply"))["summary"].alias("summary")).where("summary is not null")
    nodes = {"chunk_nodes": graph.chunk_nodes(chunks, summaries), "document_nodes": tables["documents"].drop("text")}
    return tables | nodes | build_graph(entities, edges, chunks)


def resolve_graph(entities: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """Mentions to resolved entities and edges. Edges are ordered by time of extraction, then by all that tells them apart."""
    found = resolve.merged(resolve.grouped(entities))
    edges = resolve.connected(resolve.remapped(relationships, resolve.surface_forms(found)), found)
    return {"entities": found, "relationships": resolve.folded(edges, ["pos"])}


def build_graph(entities: DataFrame, relationships: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The graph's tables from resolved entities, edges and chunks."""
    return {
        "entity_nodes": graph.entity_nodes(entities), "edges": graph.typed_edges(relationships, entities, ["arrived"]),
        "extracted_from": graph.extracted_from(entities, chunks), "next_chunk": graph.next_chunk(chunks),
    }


def ask(questions: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, links: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """``question_id, context, tokens`` for ``question_id, question, embedding``.

    ``entities`` has ``entity_id, name, type, description, aliases, source_chunk_ids, embedding`` with unique names, ``edges``
    has ``source_entity, label, target_entity, description``, ``chunks`` has ``chunk_id, text, source_file``. Names of vector hits
    are matched exactly, keywords of the question by containment. Every question has a row, if only of headers.
    """
    config = config or EngineConfig()
    # hits are few, k a question, and four steps start from them
    vector = checkpointed(search.vector_top_k(questions, entities, config.top_k).join(entities.select("entity_id", "name"), "entity_id"))
    exact = search.exact_matches(vector.select("question_id", F.col("name").alias("wanted")), entities)
    asked = questions.select("question_id", F.explode(search.keywords(F.col("question"))).alias("keyword"))
    fuzzy = search.fuzzy_matches(asked, entities, config.top_k)
    hits = checkpointed(search.fused(exact.union(fuzzy), vector, config.graph_weight, config.vector_weight))
    near = search.neighbours(hits, edges).select("question_id", "name", F.lit(0.0).alias("combined_score"))
    told = hits.select("question_id", "name", "combined_score").union(near).join(entities.select("name", "type", "description"), "name")
    found = search.connected_chunks(hits, graph.extracted_from(entities, chunks))
    found = checkpointed(search.expanded_chunks(found, links))
    # the texts of other chunks are neither deduplicated nor shuffled
    wanted = small(checkpointed(found.select("chunk_id").distinct()))
    passages = found.join(chunks.select("chunk_id", "text", "source_file").join(wanted, "chunk_id", "left_semi"), "chunk_id")
    return context.contexts(told, search.incident_edges(hits, edges), passages, config.context_tokens, questions)


def answer(questions: DataFrame, stored: dict[str, DataFrame], embedder: Callable[[str], list[float]], generate: Callable[[str], str], config: EngineConfig | None = None) -> DataFrame:
    """``question_id, question, context, answer, error`` for ``question_id, question`` over the tables that an ingest has stored.

    Without entities the passages are those that hold the question's keywords. A failed answer is its row's error."""
    config = config or EngineConfig()
    questions = checkpointed(embed(questions, "question", embedder))
    held = stored["chunks"].select("chunk_id", "text", F.col("file_hash").alias("source_file"))
    if "entities" in stored and "edges" in stored:
        entities = stored["entities"].withColumn("entity_id", F.xxhash64("name"))
        found = ask(questions, entities, stored["edges"], held, stored["next_chunk"], config)
    else:
        asked = questions.select("question_id", F.explode(search.keywords(F.col("question"))).alias("keyword"))
        hits = search.fuzzy_matches(asked, held.select(F.col("chunk_id").alias("name"), F.col("text").alias("description")), config.top_k)
        passages = hits.select("question_id", F.col("name").alias("chunk_id"), F.lit(0).alias("hop")).join(held, "chunk_id")
        none = questions.limit(0).select("question_id", *[F.lit("").alias(c) for c in ("name", "type", "description")], F.lit(0.0).alias("combined_score"))
        edges = questions.limit(0).select("question_id", *[F.lit("").alias(c) for c in ("source_entity", "label", "target_entity", "description")])
        found = context.contexts(none, edges, passages, config.context_tokens, questions)
    told = checkpointed(questions.select("question_id", "question").join(found.select("question_id", "context"), "question_id"))
    return told.join(answers(told, generate), "question_id")
