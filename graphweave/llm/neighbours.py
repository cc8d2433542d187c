"""The k most similar vectors of every vector (problem 3).

Additive quantisation: a vector is the sum of one full-dimensional codeword from each of several codebooks, trained on
residuals and chosen by beam search. The first two codebooks also split the vectors into lists, one for each pair of their
words; the number of lists grows with the table, so that a list stays of one size. A query looks up its nearest lists,
scores their members from lookup tables and stored norms, and the best are ranked again by the exact cosine in double
precision.

Only vectors of exactly ``DIMENSIONS`` finite numbers, not all zero, take part; null, short and other vectors are in no
result. Equal vectors are searched once: a group of copies, however large, is one vector in the index with its smallest
ids. Repeated rows count once. Similarities are rounded to 6 decimals, ties go to the smaller id. With fewer than k
other vectors all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import checkpointed, spread

DIMENSIONS, NEIGHBOURS = 64, 5
#: Vectors that the codebooks are fitted on at most (by hash of their id), which bounds what comes to the driver; lists hold
#: about LIST_SIZE vectors, and the first codebook has at most FIRST_WORDS words, the second as many as the lists then need.
MOST_TRAINING, LIST_SIZE, FIRST_WORDS = 30_000, 256, 1024
#: Codebooks after these two, words of each, beam of the encoding, lists looked up, candidates of a list ranked exactly.
CODEBOOKS, WORDS, BEAM, PROBES, RERANKED = 12, 256, 4, 5, 64
#: Members and queries of one task's group; larger lists are split in both. Copies of a vector that meet in one task.
MOST_MEMBERS, MOST_QUERIES, MOST_COPIES = 4_000, 40_000, 50_000
#: Words of the first codebook whose pairs with the second one's a query compares.
NEAR_WORDS = 16


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = 0.5 * (words**2).sum(1)
    return np.concatenate([(points[at : at + 2048] @ words.T - half).argmax(1) for at in range(0, max(1, len(points)), 2048)])


def _k_means(points: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 10) -> np.ndarray:
    words = points[draw.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = _nearest(points, words)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(points[order], first, 0)
        counts = np.diff(np.r_[first, len(points)])
        words[found] = sums / counts[:, None]
        empty = np.setdiff1d(np.arange(k), found)
        words[empty] = points[draw.choice(len(points), len(empty))]
    return words


@dataclass(frozen=True)
class Codebooks:
    """Two codebooks whose pairs of words are the lists, then ``CODEBOOKS`` full-dimensional books of residual words."""

    first: np.ndarray
    second: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 11) -> Codebooks:
        draw, most = np.random.default_rng(seed), max(1, len(sample) // 6)
        first = _k_means(sample, max(1, min(lists, FIRST_WORDS, most)), draw)
        rest, books = sample - first[_nearest(sample, first)], []
        many = min(-(-lists // len(first)), most)
        second = _k_means(rest, many, draw) if many > 1 else np.zeros((1, sample.shape[1]), sample.dtype)
        rest = rest - second[_nearest(rest, second)]
        for _ in range(CODEBOOKS):
            book = _k_means(rest, WORDS, draw, 6)
            rest = rest - book[_nearest(rest, book)]
            books.append(book)
        return Codebooks(first.astype(np.float32), second.astype(np.float32), np.array(books, np.float32))

    def centre(self, number: int) -> np.ndarray:
        return self.first[number // len(self.second)] + self.second[number % len(self.second)]

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list, the codes and the stored norm of each vector; a beam of partial sums is kept from book to book."""
        near = _nearest(points, self.first)
        rest = points - self.first[near]
        then = _nearest(rest, self.second)
        rest = (rest - self.second[then])[:, None, :]
        rows = np.arange(len(points))
        codes = np.zeros((len(points), 1, 0), np.uint8)
        for book in self.books:
            error = (rest.reshape(-1, rest.shape[2]) @ (-2 * book).T).reshape(len(points), rest.shape[1], -1) + (book**2).sum(1)
            if rest.shape[1] > 1:
                error += (rest**2).sum(2)[:, :, None]
            flat = error.reshape(len(points), -1)
            best = np.empty((len(points), min(BEAM, flat.shape[1])), np.int64)
            for k in range(best.shape[1]):
                best[:, k] = flat.argmin(1)
                flat[rows, best[:, k]] = np.inf
            path, word = best // WORDS, best % WORDS
            rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        final = (rest**2).sum(2).argmin(1)
        return near * len(self.second) + then, codes[rows, final], np.linalg.norm(points - rest[rows, final], axis=1)

    def probes(self, points: np.ndarray) -> np.ndarray:
        """The lists in which each vector looks for others: the nearest pairs of a near word of the first codebook and any of
        the second."""
        close = points @ self.first.T - 0.5 * (self.first**2).sum(1)
        words = _largest(close, NEAR_WORDS)
        whole = np.take_along_axis(close, words, 1)[:, :, None]
        if len(self.second) > 1:
            second = 0.5 * (self.second**2).sum(1)
            whole = whole + (points @ self.second.T)[:, None, :] - (self.first @ self.second.T)[words] - second
        best = _largest(whole.reshape(len(points), -1), PROBES)
        return np.take_along_axis(words, best // len(self.second), 1) * len(self.second) + best % len(self.second)


def _largest(values: np.ndarray, many: int) -> np.ndarray:
    """The places of the ``many`` largest values of each row, in any order."""
    if many >= values.shape[1]:
        return np.tile(np.arange(values.shape[1]), (len(values), 1))
    return np.argpartition(values, values.shape[1] - many, 1)[:, -many:]


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _units(column: pa.Array, kind: type) -> np.ndarray:
    """Unit vectors in double precision from the bytes of the table's own type, which is what is shuffled."""
    rows = _matrix(column, kind, DIMENSIONS).astype(float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def valid_vectors(entities: DataFrame) -> DataFrame:
    """``entity_id, vec`` of the rows whose embedding takes part, once each."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.size("embedding") == DIMENSIONS) & sound & F.exists("embedding", lambda x: x != 0)
    return entities.where(F.col("embedding").isNotNull() & usable).select("entity_id", F.col("embedding").alias("vec"))


def fit_codebooks(vectors: DataFrame) -> Codebooks | None:
    """Codebooks for a table of ``entity_id, vec``, fitted on at most ``MOST_TRAINING`` rows; None for an empty table."""
    rows = vectors.orderBy(F.xxhash64("entity_id")).limit(MOST_TRAINING).select("vec").collect()
    if not rows:
        return None
    sample = np.array([r.vec for r in rows], np.float32)
    sample /= np.linalg.norm(sample.astype(float), axis=1, keepdims=True).astype(np.float32)
    total = vectors.count()
    return Codebooks.fit(sample, max(1, total // LIST_SIZE))


def _index(vectors: DataFrame, books: Codebooks, kind: type) -> DataFrame:
    """``rep, vec, codes, norm, list, probes`` of every vector; ``vec`` has its numbers' bytes as ``kind``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("vec")
                raw = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DIMENSIONS)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                points = unit.astype(np.float32)
                near, codes, norms = books.encode(points)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rep"), pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary()),
                        pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norms.astype(np.float32)),
                        pa.array(near.astype(np.int32)), pa.array(books.probes(points).astype(np.int32).tolist(), pa.list_(pa.int32())),
                    ],
                    names=["rep", "vec", "codes", "norm", "list", "probes"],
                )

    return spread(vectors).mapInArrow(work, "rep bigint, vec binary, codes binary, norm float, list int, probes array<int>")


def _search(books: Codebooks, k: int, kind: type):
    """The best ``k`` of a list's members for each query that looks it up."""

    def work(members: pa.Table, queries: pa.Table) -> pa.Table:
        empty = {"rep": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
        if not members.num_rows or not queries.num_rows:
            return pa.table(empty)
        exact, codes = _units(members["vec"], kind), _matrix(members["codes"], np.uint8, CODEBOOKS)
        norms, ids = members["norm"].to_numpy(), members["rep"].to_numpy()
        centre = books.centre(members["list"][0].as_py())
        wanted, asking = _units(queries["q_vec"], kind), queries["q_rep"].to_numpy()
        out = []
        for at in range(0, len(wanted), 512):
            some, who = wanted[at : at + 512], asking[at : at + 512]
            tables = np.einsum("qd,mwd->mqw", some.astype(np.float32), books.books, optimize=True)
            scores = np.repeat((some.astype(np.float32) @ centre)[:, None], len(ids), 1)
            for m in range(CODEBOOKS):
                scores += tables[m][:, codes[:, m]]
            scores /= np.maximum(norms, 1e-9)
            many = min(RERANKED, len(ids))
            best = _largest(scores, many)
            similarity = np.round(np.einsum("qd,qrd->qr", some, exact[best]), 6)
            other = ids[best]
            similarity[other == who[:, None]] = -9
            order = np.lexsort((other, -similarity), axis=1)[:, :k]
            similarity, other = np.take_along_axis(similarity, order, 1), np.take_along_axis(other, order, 1)
            keep = similarity > -9
            out.append((np.repeat(who, order.shape[1])[keep.ravel()], other[keep], similarity[keep]))
        return pa.table({n: np.concatenate(x) for n, x in zip(empty, zip(*out))})

    return work


def _split_lists(index: DataFrame) -> DataFrame:
    """``list, parts, shares``: into how many parts the members and the queries of long lists are split; other lists are left
    out. One row in at least ``MOST_MEMBERS`` vectors, broadcast only while that is a short table."""
    counts = index.select("list", F.lit(1).alias("m"), F.lit(0).alias("q")).union(index.select(F.explode("probes"), F.lit(0), F.lit(1)))
    counts = counts.groupBy("list").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).where((F.col("m") > MOST_MEMBERS) | (F.col("q") > MOST_QUERIES))
    parts = F.greatest(F.ceil(F.col("m") / MOST_MEMBERS), F.lit(1)).cast("int")
    shares = F.greatest(F.ceil(F.col("q") / MOST_QUERIES), F.lit(1)).cast("int")
    found = checkpointed(counts.select("list", parts.alias("parts"), shares.alias("shares")))
    return F.broadcast(found) if found.count() <= 100_000 else found


def _hot_vectors(vectors: DataFrame) -> DataFrame:
    """``h, copies``: the hashes of vectors of so many rows that these are joined in parts. They have a thousandth of all
    rows at least, so they are at most a thousand and can be broadcast."""
    counts = checkpointed(vectors.groupBy("h").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    hot = counts.where(F.col("n") > max(MOST_COPIES, total // 1000))
    return F.broadcast(hot.select("h", F.ceil(F.col("n") / MOST_COPIES).cast("int").alias("copies")))


def nearest(entities: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``entity_id, other_id, similarity, rank``: the ``k`` most similar others of every row that takes part."""
    # the hash stands first in all keys: rows are sorted by it and arrays compared only where it is equal
    vectors = valid_vectors(entities).withColumn("h", F.xxhash64("vec"))
    spark = entities.sparkSession
    order = Window.partitionBy("h", "vec").orderBy("entity_id")
    first = vectors.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
    groups = first.groupBy("h", "vec").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    groups = checkpointed(groups.withColumn("rep", F.element_at("ids", 1)))
    books = fit_codebooks(groups.select(F.col("rep").alias("entity_id"), "vec"))
    if books is None:
        return spark.createDataFrame([], "entity_id bigint, other_id bigint, similarity double, rank int")
    kind = np.float32 if dict(groups.dtypes)["vec"] == "array<float>" else np.float64
    index = checkpointed(_index(groups.select("rep", "vec"), books, kind))
    lists = _split_lists(index)
    one = {"parts": F.coalesce("parts", F.lit(1)), "shares": F.coalesce("shares", F.lit(1))}
    members = index.join(lists, "list", "left").withColumns(one).select(
        "list", F.expr("pmod(xxhash64(rep), parts)").alias("part"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"),
        "rep", "vec", "codes", "norm",
    )
    queries = index.select("rep", "vec", F.explode("probes").alias("list")).join(lists, "list", "left").withColumns(one)
    queries = queries.select(
        F.col("list").alias("q_list"), F.explode(F.expr("sequence(0L, parts - 1L)")).alias("q_part"),
        F.expr("cast(pmod(xxhash64(rep), shares) as int)").alias("q_share"), F.col("rep").alias("q_rep"), F.col("vec").alias("q_vec"),
    )
    keys = ["list", "part", "share"]
    # both sides in the same number of partitions, which adaptive execution then leaves as it is
    parts, q_keys = int(spark.conf.get("spark.sql.shuffle.partitions")), [f"q_{x}" for x in keys]
    asking = queries.repartition(parts, *q_keys).groupBy(*q_keys)
    found = members.repartition(parts, *keys).groupBy(*keys).cogroup(asking).applyInArrow(_search(books, k, kind), "rep bigint, other bigint, similarity double")
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    near = found.groupBy("rep").agg(F.collect_list(F.struct("other", "similarity")).alias("near"))
    ids = groups.select(F.col("rep").alias("other"), F.col("ids").alias("other_ids"))
    spelled = (
        near.select("rep", F.explode("near").alias("x")).select("rep", "x.*").join(ids, "other")
        .groupBy("rep").agg(F.flatten(F.collect_list(F.expr("transform(other_ids, i -> struct(-similarity AS s, i AS id))"))).alias("others"))
    )
    # copies of a vector have each other at similarity 1; at most k + 1 ids of a group are ever needed
    own = F.expr("transform(ids, i -> struct(-1.0D AS s, i AS id))")
    asked = groups.join(spelled, "rep", "left").select("h", "vec", F.concat(own, F.coalesce("others", F.expr("filter(transform(ids, i -> struct(-1.0D AS s, i AS id)), x -> false)"))).alias("all"))
    single = F.expr(f"slice(array_sort(filter(all, x -> x.id != entity_id)), 1, {k})")
    hot = _hot_vectors(vectors)
    copies = F.coalesce("copies", F.lit(1))
    held = vectors.dropDuplicates(["entity_id", "h", "vec"]).join(hot, "h", "left").withColumn("copy", F.pmod(F.hash("entity_id"), copies))
    asked = asked.join(hot, "h", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    rows = held.join(asked.select("h", "vec", "copy", "all"), ["h", "copy", "vec"]).select("entity_id", F.posexplode(single).alias("n", "x"))
    return rows.select("entity_id", F.col("x.id").alias("other_id"), (-F.col("x.s")).alias("similarity"), (F.col("n") + 1).alias("rank"))


def nearest_pairs(entities: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``entity_id_a, entity_id_b``: the pairs of which one is among the ``k`` most similar of the other."""
    a, b = F.least("entity_id", "other_id"), F.greatest("entity_id", "other_id")
    return nearest(entities, k).select(a.alias("entity_id_a"), b.alias("entity_id_b")).distinct()
