"""The registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import text as T
from graphweave.operators import chunking, clean, context, graph, mentions, metadata, resolve, search, validate
from graphweave.plans import oracle, pipeline
from graphweave.session import checkpointed, spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()


# what several queries start from


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents; a small table of one file is spread over the cores, since work on texts follows."""
    return spread(table(spark, sf, "documents").select("doc_id", "file_hash", "text"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks, repeated deliveries once."""
    return graph.upsert(None, table(spark, sf, "chunks"), ["chunk_id"], "ingested_at")


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").withColumnRenamed("entity_id", "pos")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The relationships, the last delivery of each, with normal type, label and weight."""
    last = metadata.latest(table(spark, sf, "relationships"), "rel_id", ["extracted_at"])
    kind = F.col("relation_type")
    return last.withColumns({"label": T.safe_label(kind), "relation_type": T.relation_type(kind), "weight": T.unit_weight(F.col("weight"))})


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").select("name").where("name is not null").distinct()


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entities after resolution, and the edges between them, folded; both written once for the steps that follow."""
    found = checkpointed(resolve.merged(resolve.grouped(_mentions(spark, sf))))
    edges = resolve.connected(resolve.remapped(_edges(spark, sf), resolve.surface_forms(found)), found)
    return found.withColumn("entity_id", F.col("first")), checkpointed(resolve.folded(edges, ["extracted_at", "rel_id"]))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The questions of all searches: every entity whose id is divisible by 50."""
    rows = table(spark, sf, "entities").where("entity_id % 50 = 0 and name is not null")
    return rows.select(F.col("entity_id").alias("question_id"), "name", F.concat(F.lit("What is "), "name", F.lit("?")).alias("question"), "embedding")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("question_id", F.explode(search.keywords(F.col("question"))).alias("keyword"))


def _vector(spark: SparkSession, sf: str) -> DataFrame:
    found = search.vector_top_k(_questions(spark, sf), table(spark, sf, "entities"))
    return found.join(table(spark, sf, "entities").select("entity_id", "name"), "entity_id")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("question_id", "name")


# documents


@query
def doc_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))


@query
def clean_regex(spark: SparkSession, sf: str) -> DataFrame:
    """All steps of cleaning but composition and repeated lines."""
    text = F.translate(clean.join_hyphenated(clean.drop_control(F.col("text"))), "\t", " ")
    text = clean.tidy(clean.drop_page_numbers(clean.drop_headers(text)))
    return _documents(spark, sf).select("doc_id", text.alias("text"))


@query
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", clean.drop_repeated_lines(F.col("text"), 2).alias("text"))


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaner, compatibility composition included."""
    return clean.clean(_documents(spark, sf)).select("doc_id", "text")


@query
def doc_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", metadata.inferred_title(F.col("text")).alias("title"), T.word_count(F.col("text")).alias("words"))


@query
def language_vote(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", metadata.voted_language(F.col("text")).alias("language"))


@query
def current_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.current_rows(table(spark, sf, "document_metadata")).select("file_hash", "title", "author", "language", "page_count")


@query
def sections(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.sections(_documents(spark, sf))
    return found.select("doc_id", "section_no", F.array_join("heading_hierarchy", " > ").alias("headings"), "body_text", "start_char")


@query
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the whole text, without sections."""
    rows = _documents(spark, sf).where("text is not null").withColumn("section_no", F.lit(0))
    return chunking.units(rows).select("doc_id", "unit_no", "unit", "tokens")


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing without overlap and without cutting."""
    rows = _documents(spark, sf).where("text is not null").withColumn("section_no", F.lit(0))
    found = chunking.packed(chunking.units(rows), 100, 0, cut=False)
    return found.select("doc_id", "part_no", "text")


@query
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the texts as they are: headings in front, oversized units cut, overlaps, ids and offsets."""
    found = chunking.chunk(_documents(spark, sf), 60, 12, "doc_id")
    headings = F.array_join("heading_hierarchy", " > ").alias("headings")
    return found.select("doc_id", "chunk_id", "chunk_index", "text", "token_count", headings, "start_char", "end_char")


@query
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ingest to chunks: cleaned, cut at headings and sentences, packed with overlap, validated."""
    return pipeline.ingest_chunks(_documents(spark, sf).drop("doc_id"))["chunks"]


@query
def chunk_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validate.judged(_chunks(spark, sf)).select("chunk_id", F.array_join("reasons", ",").alias("reasons"))


@query
def reject_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return validate.reason_counts(_chunks(spark, sf))


# mentions, entities and edges


@query
def json_mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _entity_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply in JSON for every entity row."""
    told = F.struct(F.array(F.struct("name", "type", "description", "aliases")).alias("entities"))
    return table(spark, sf, "entities").select(F.col("entity_id").cast("string").alias("chunk_id"), F.to_json(told).alias("reply"))


@query
def reply_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity mentions parsed from replies in JSON."""
    found = mentions.entity_mentions(_entity_replies(spark, sf))
    return found.select("chunk_id", "pos", "name", "type", "description", F.array_join("aliases", "|").alias("aliases"))


@query
def reply_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relationship mentions parsed from replies in JSON within code fences."""
    told = F.struct(F.array(F.struct("source_entity", "target_entity", "relation_type", "description", "weight")).alias("relationships"))
    rows = table(spark, sf, "relationships").select("rel_id", "extracted_at", F.concat(F.lit("```json\n"), F.to_json(told), F.lit("\n```")).alias("reply"))
    rows = rows.select(F.concat_ws("/", "rel_id", F.unix_micros(F.col("extracted_at").cast("timestamp"))).alias("chunk_id"), "reply")
    found = mentions.relationship_mentions(rows)
    return found.select("chunk_id", "source_entity", "target_entity", "relation_type", "description", F.round("weight", 6).alias("weight"))


@query
def reply_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Records of replies in delimited tuples."""
    record = F.concat_ws("<|>", F.lit('("entity"'), F.coalesce("name", F.lit("")), F.concat(F.coalesce("type", F.lit("")), F.lit(")##\n<|COMPLETE|>")))
    rows = table(spark, sf, "entities").select(F.col("entity_id").cast("string").alias("chunk_id"), record.alias("reply"))
    return mentions.tuple_mentions(rows).select("chunk_id", "pos", F.array_join("fields", "|").alias("fields"))


@query
def weight_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "relationships").select("rel_id", "extracted_at", F.round(T.unit_weight(F.col("weight")), 6).alias("weight"))


@query
def label_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("relation_type")
    rows = table(spark, sf, "relationships").select(T.relation_type(kind).alias("type"), T.safe_label(kind).alias("label"))
    return rows.groupBy("type", "label").agg(F.count("*").alias("n"))


@query
def entity_group(spark: SparkSession, sf: str) -> DataFrame:
    found = resolve.grouped(_mentions(spark, sf))
    lists = {c: F.array_join(c, "|") for c in ("aliases", "source_chunk_ids")}
    return found.withColumns(lists).select("key", "name", "type", "description", "aliases", "source_chunk_ids", "mentions")


@query
def type_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.type_conflicts(_mentions(spark, sf))


@query
def alias_components(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.components(resolve.alias_links(resolve.grouped(_mentions(spark, sf))))


@query
def resolved_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities after the merge by aliases."""
    found = resolve.merged(resolve.grouped(_mentions(spark, sf)))
    return resolve.embedding_text(found).select("key", "name", "type", "embedding_text", "mentions", F.size("aliases").alias("n_aliases"), F.size("source_chunk_ids").alias("n_chunks"))


@query
def resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between resolved entities, folded; the order is that of extraction."""
    return _resolved(spark, sf)[1].select("source_entity", "target_entity", "relation_type", F.round("weight", 6).alias("weight"), "mentions")


@query
def edge_remap(spark: SparkSession, sf: str) -> DataFrame:
    forms = resolve.surface_forms(resolve.grouped(_mentions(spark, sf)))
    return resolve.remapped(_edges(spark, sf), forms).select("rel_id", "source_entity", "target_entity")


@query
def edge_fold(spark: SparkSession, sf: str) -> DataFrame:
    found = resolve.folded(_edges(spark, sf), ["extracted_at", "rel_id"])
    return found.select("source_entity", "target_entity", "relation_type", F.round("weight", 6).alias("weight"), "description", "mentions")


@query
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.dangling(_edges(spark, sf), _names(spark, sf)).select("rel_id")


@query
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.orphans(_names(spark, sf), _edges(spark, sf)).select("name")


# graph


@query
def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.typed_edges(_edges(spark, sf), _names(spark, sf), ["extracted_at", "rel_id"])
    return found.select("source_entity", "label", "target_entity", "description", F.round("weight", 6).alias("weight"))


@query
def extracted_from(spark: SparkSession, sf: str) -> DataFrame:
    return graph.extracted_from(table(spark, sf, "entities"), _chunks(spark, sf))


@query
def next_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.next_chunk(_chunks(spark, sf))


@query
def part_of(spark: SparkSession, sf: str) -> DataFrame:
    return graph.part_of(_chunks(spark, sf), graph.document_nodes(table(spark, sf, "document_metadata")))


@query
def type_quality(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_quality(table(spark, sf, "entities"))


@query
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    entities = checkpointed(resolve.merged(resolve.grouped(_mentions(spark, sf))))
    return graph.node_counts(Chunk=_chunks(spark, sf), Entity=entities, Embedded=entities.where("embedding is not null"), Document=graph.document_nodes(table(spark, sf, "document_metadata")), Edge=_edges(spark, sf))


@query
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.upsert(None, table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts")
    return found.select("user_id", "event_id", "event_type")


# search


@query
def keyword_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = _edges(spark, sf).where("description is not null")
    return rows.select("rel_id", F.array_join(search.keywords(F.col("description")), "|").alias("keywords"))


@query
def question_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).where("description is not null").select("rel_id", search.intent(F.col("description")).alias("intent"))


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_top_k(_questions(spark, sf), table(spark, sf, "entities"))


@query
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.exact_matches(_seeds(spark, sf).withColumnRenamed("name", "wanted"), table(spark, sf, "entities"))


@query
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy_matches(_asked(spark, sf), table(spark, sf, "entities"))


@query
def score_fusion(spark: SparkSession, sf: str) -> DataFrame:
    entities = table(spark, sf, "entities")
    exact = search.exact_matches(_seeds(spark, sf).withColumnRenamed("name", "wanted"), entities)
    return search.fused(exact.union(search.fuzzy_matches(_asked(spark, sf), entities)), _vector(spark, sf))


@query
def neighbours_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return search.neighbours(_seeds(spark, sf), _edges(spark, sf))


@query
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf).select("rel_id", "source_entity", "target_entity")
    return search.incident_edges(_seeds(spark, sf), edges).select("question_id", "rel_id")


@query
def connected_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return search.connected_chunks(_seeds(spark, sf), graph.extracted_from(table(spark, sf, "entities"), _chunks(spark, sf)))


@query
def chunk_expand(spark: SparkSession, sf: str) -> DataFrame:
    return search.expanded_chunks(connected_chunks(spark, sf), graph.next_chunk(_chunks(spark, sf)))


@query
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each file that fit a budget, in order, up to the first that does not."""
    rows = _chunks(spark, sf).withColumn("tokens", T.token_count(F.col("text")))
    return context.within_budget(rows, ["chunk_id"], F.lit(2500), "file_hash").select("file_hash", "chunk_id", "spent")


@query
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the context of every question, from vector search over resolved entities to passages within the budget."""
    light = table(spark, sf, "chunks").select("chunk_id", "file_hash", "chunk_index", "ingested_at")
    light = checkpointed(graph.upsert(None, light, ["chunk_id"], "ingested_at"))
    held = _chunks(spark, sf).select("chunk_id", "text", F.col("file_hash").alias("source_file"))
    entities, edges = _resolved(spark, sf)
    typed = checkpointed(graph.typed_edges(edges, entities, ["arrived"]))
    return pipeline.ask(_questions(spark, sf), entities, typed, held, graph.next_chunk(light))
