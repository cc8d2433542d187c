"""Keywords, matching, score fusion and traversal for a table of questions; every join carries ``question_id``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import let, strip
from graphweave.session import checkpointed, small

# Words that are no keywords.
STOP_WORDS = """a an the is are was were be been being have has had do does did will would could should may might shall can need must
ought i me my we our you your he him his she her it its they them their this that these those what which who whom whose where when why
how all each every both few more most some any no not only own same so than too very just about above after again against along also
among and as at because before below between but by down during for from if in into nor of on or out over per then through to under
until up upon with without tell explain describe give show please know find get make go see look come think say take want use used""".split()
# What a question holds for each intent, the first that fits.
INTENTS = {
    "aggregation": ("how many", "count", "total", "all the"), "procedural": ("how does", "how do", "how to", "steps", "process"),
    "comparative": ("compare", "differ", "versus", "vs"), "exploratory": ("what is", "explain", "describe", "tell me about"),
}
EXACT_SCORE, FUZZY_SCORE = 1.0, 0.7
BASE_ROWS, QUERY_ROWS = 50_000, 4_000


def keywords(question: Column) -> Column:
    """One, two and three words in a row of a question without stop words, each spelling once, in order."""
    tokens = F.regexp_extract_all(question, F.lit(r"[a-zA-Z0-9_'-]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~F.lower(t).isin(STOP_WORDS) & (F.length(t) > 1))

    def spans(words: Column, n: int) -> Column:
        return F.filter(F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, n), " ")), lambda _, i: i <= F.size(words) - n)

    def once(every: Column) -> Column:
        return let(F.transform(every, F.lower), lambda lower: F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1))

    return let(let(kept, lambda words: F.concat(spans(words, 1), spans(words, 2), spans(words, 3))), once)


def intent(question: Column) -> Column:
    found = F.lit("factual")
    for name, parts in reversed(INTENTS.items()):
        fits = F.lit(False)
        for part in parts:
            fits = fits | F.contains(F.lower(question), F.lit(part))
        found = F.when(fits, name).otherwise(found)
    return found


def vector_top_k(questions: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """``question_id, entity_id, score``: the ``k`` entities of greatest cosine for each question, the smaller id first among
    equals at six decimals. Embeddings that are null, of another length, not finite or all zero take no part.

    Questions and entities meet in blocks of bounded size, one matrix product each; only ``k`` rows a question and block
    are shuffled again.
    """

    def sound(df: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))

    base = sound(entities.select("entity_id", "embedding")).distinct()
    asked = sound(questions.select("question_id", "embedding")).distinct()
    shares, blocks = -(-base.count() // BASE_ROWS) or 1, -(-asked.count() // QUERY_ROWS) or 1
    base = base.select(
        F.pmod(F.xxhash64("entity_id"), F.lit(shares)).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.size("embedding").alias("width"), "entity_id", "embedding",
    )
    asked = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("q_share"), F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("q_block"),
        F.size("embedding").alias("q_width"), "question_id", F.col("embedding").alias("q_embedding"),
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"question_id": pa.array([], pa.int64()), "entity_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows, wanted = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) for t, c in ((left, "embedding"), (right, "q_embedding")))
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
        ids, who, out = left["entity_id"].to_numpy(), right["question_id"].to_numpy(), []
        order = np.argsort(ids)
        rows, ids = rows[order], ids[order]
        for at in range(0, len(wanted), 256):
            scores = np.round(wanted[at : at + 256] @ rows.T, 6)
            if scores.shape[1] > 4 * k:  # all that are as good as the k-th, then in order
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                places = [np.flatnonzero(row >= low) for row, low in zip(scores, least)]
                best = np.array([p[np.argsort(-row[p], kind="stable")[:k]] for row, p in zip(scores, places)])
            else:
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(who[at : at + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel()))
        return pa.table({n: np.concatenate(c) for n, c in zip(("question_id", "entity_id", "score"), zip(*out))})

    keys, parts = ("share", "block", "width"), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked_keys = [f"q_{x}" for x in keys]
    # both sides in the same number of partitions, which adaptive execution then leaves as it is
    met = base.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *asked_keys).groupBy(*asked_keys))
    found = met.applyInArrow(score, "question_id bigint, entity_id bigint, score double")
    n = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "entity_id"))
    return found.withColumn("n", n).where(F.col("n") <= k).drop("n")


def index_score(cosine: Column) -> Column:
    """The score in [0, 1] that vector indexes give for a cosine."""
    return (1 + cosine) / 2


def exact_matches(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """``question_id, name, score``: entities with a wanted name, as name or alias, by equality of the lower case."""
    spelled = entities.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    spelled = spelled.select("name", F.lower("s").alias("key")).where("key is not null").distinct()
    asked = wanted.select("question_id", strip(F.lower("wanted")).alias("key")).distinct()
    return asked.join(spelled, "key").select("question_id", "name", F.lit(EXACT_SCORE).alias("score")).distinct()


def fuzzy_matches(asked: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """``question_id, name, score``: the first ``k`` entities by name whose name or description contains a keyword.

    Each keyword is looked up by its rarest three letters (two if it is that short) among those of all entities, then
    compared: an equality join instead of all pairs. Postings are an id and the letters; the texts are shuffled once, and only
    to the keywords that share letters with them. Of a keyword's entities the first ``k`` are enough for any question.
    """
    width = 3
    text = F.lower(F.concat_ws("\n", "name", "description"))
    rows = entities.where("name is not null").select("name", text.alias("text")).distinct()
    # rows of one hash are all compared, so an id need not be unique
    rows = rows.withColumn("row", F.xxhash64("name", "text"))

    def grams(c: str, n: int) -> Column:
        size = F.length(c)
        return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    words = checkpointed(asked.select("question_id", strip(F.lower("keyword")).alias("word")).where("length(word) >= 2").distinct())
    single = words.select("word").distinct()
    lengths = [r.n for r in single.select(F.least(F.length("word"), F.lit(width)).alias("n")).distinct().collect()]  # 2, 3 or both
    looked = single.withColumn("gram", F.explode(F.when(F.length("word") >= width, grams("word", width)).otherwise(grams("word", 2))))
    looked = checkpointed(looked)
    # the letters of the keywords; all others stay where they are
    wanted = small(checkpointed(looked.select("gram").distinct()))
    parts = [grams("text", n) for n in sorted(lengths)] or [F.array().cast("array<string>")]
    index = checkpointed(rows.select("row", F.explode(F.concat(*parts)).alias("gram")).join(wanted, "gram", "left_semi"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = looked.join(often, "gram", "left")
    rarest = rarest.groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(index, "gram").select("word", "row")
    hits = met.join(rows, "row").where("contains(text, word)").select("word", "name")
    first = F.dense_rank().over(Window.partitionBy("word").orderBy("name"))
    hits = hits.withColumn("n", first).where(F.col("n") <= k).select("word", "name").distinct()
    found = words.join(hits, "word").select("question_id", "name").distinct()
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("name"))
    return found.withColumn("n", n).where(F.col("n") <= k).select("question_id", "name", F.lit(FUZZY_SCORE).alias("score"))


def fused(graph: DataFrame, vector: DataFrame, graph_weight: float = 0.6, vector_weight: float = 0.4) -> DataFrame:
    """``question_id, name, graph_score, vector_score, combined_score`` from hits of both sides, the best of each."""
    zero = F.lit(0.0)
    rows = graph.select("question_id", "name", F.col("score").alias("g"), zero.alias("v")).union(vector.select("question_id", "name", zero.alias("g"), F.col("score").alias("v")))
    both = rows.groupBy("question_id", "name").agg(F.max("g").alias("graph_score"), F.max("v").alias("vector_score"))
    return both.withColumn("combined_score", F.round(F.col("graph_score") * graph_weight + F.col("vector_score") * vector_weight, 6))


def _seeded(seeds: DataFrame) -> DataFrame:
    """The seeds once, broadcast where they are few: then no edge is shuffled for them, however many edges a name has."""
    return small(checkpointed(seeds.select("question_id", "name").where("name is not null").distinct()))


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``question_id, name``: entities one edge away from a seed, in either direction, that are no seeds."""
    seeds = _seeded(seeds)
    ways = [("source_entity", "target_entity"), ("target_entity", "source_entity")]
    ends = [edges.join(seeds.withColumnRenamed("name", a), a).select("question_id", F.col(b).alias("name")) for a, b in ways]
    return ends[0].union(ends[1]).where("name is not null").distinct().join(seeds, ["question_id", "name"], "left_anti")


def incident_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with a seed at either end, once for each question."""
    seeds = _seeded(seeds)
    ends = [edges.join(seeds.withColumnRenamed("name", side), side).select("question_id", *edges.columns) for side in ("source_entity", "target_entity")]
    return ends[0].union(ends[1]).distinct()


def connected_chunks(seeds: DataFrame, provenance: DataFrame) -> DataFrame:
    """``question_id, chunk_id`` of the chunks that seeds were extracted from."""
    held = provenance.select(F.col("entity_name").alias("name"), "chunk_id")
    return seeds.select("question_id", "name").distinct().join(held, "name").select("question_id", "chunk_id").distinct()


def expanded_chunks(found: DataFrame, links: DataFrame) -> DataFrame:
    """``question_id, chunk_id, hop``: the found chunks (0) and those next to them (1), each at its least distance."""
    both = links.select(F.col("current_chunk_id").alias("chunk_id"), F.col("next_chunk_id").alias("near"))
    both = both.union(both.select(F.col("near").alias("chunk_id"), F.col("chunk_id").alias("near")))
    near = found.join(both, "chunk_id").select("question_id", F.col("near").alias("chunk_id"), F.lit(1).alias("hop"))
    rows = found.select("question_id", "chunk_id", F.lit(0).alias("hop")).union(near)
    return rows.groupBy("question_id", "chunk_id").agg(F.min("hop").alias("hop"))
