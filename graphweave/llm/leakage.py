"""Evaluation texts that leaked into training text (problem 7).

Every task sorts all suffixes of the words of its shards of the corpus into suffix arrays and binary-searches every suffix of
the test items in them: that gives the longest verbatim matches with their places. Matches of at least three words become
passages, across single words that differ; a document is affected if one or two passages in order hold at least half of
an item's words. The corpus is read once, however many items there are: test items beyond a bound of characters are not sent
to the tasks but met in a join on the hashes of three words in a row, which gives the same matches.

Words are compared without case, accents, punctuation, mark-up and look-alike characters. Null and blank texts of either
side match nothing, an item with fewer than three words is never found, repeated rows count once, empty tables give empty
results, extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.textnorm import prototypes
from graphweave.session import spread

#: Words of a verbatim match; most differing words between two matches of a passage, on either side; words that a
#: passage must have more than; share of the item's words that the passages must hold.
RUN, GAP, SHARED, SHARE = 3, 4, 8, 0.5
#: Characters of a shard, and of all test items that are sent to every task: bounds of a task's memory.
SHARD_CHARS, MOST_ITEM_CHARS = 4_000_000, 4_000_000


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """What each code point counts as in a word: a folded letter or digit, 0 for a gap, 1 for nothing at all."""
    table = np.zeros(0x110000, np.uint32)
    same = prototypes()
    for code in range(0x30000):
        ch = chr(code)
        if unicodedata.category(ch) in ("Mn", "Cf") or (same[code] == "" and code > 127):
            table[code] = 1
        elif ch.isalnum():
            folded = same[code].lower()
            table[code] = ord(folded) if len(folded) == 1 else code
    return table


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and the text that it is in."""
    parts = [t if t.isascii() else unicodedata.normalize("NFD", _spelled(t)) for t in texts]
    joined, ends = "\n".join(parts), np.cumsum([len(t) + 1 for t in parts])
    code = _folds()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code != 1
    place = np.flatnonzero(keep)
    code = code[keep]
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = code != 0
    first = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.maximum.accumulate(np.where(inside & ~np.r_[False, inside[:-1]], np.arange(len(code)), 0))
    term = np.where(inside, (code.astype(np.uint64) + np.uint64(7)) * _POWERS[(np.arange(len(code)) - start) % len(_POWERS)], 0)
    hashed = np.add.reduceat(term, first)
    return (hashed ^ (hashed >> np.uint64(29))) | np.uint64(1), np.searchsorted(ends, place[first], "right")


def _spelled(text: str) -> str:
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st")):
        text = text.replace(ligature, letters)
    return text


class SuffixArray:
    """All suffixes of a shard's words in order, up to ``depth`` words; no suffix goes on behind the end of its text.

    Ranks are doubled: the rank of two times as many words comes from the ranks of both halves. The ranks of every
    length stay, so that the common start of any two suffixes is found by halving.
    """

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, depth: int) -> None:
        self.owner, self.levels, self.pairs = owner, [], []
        self.known, rank = np.unique(hashes, return_inverse=True)
        self.ends = np.searchsorted(owner, owner, "right")  # where each suffix's text ends
        length = 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if length >= depth or rank.max(initial=0) + 1 == len(rank):
                break
            # a suffix that is shorter comes first: behind its end there is the rank -1
            joined = rank.astype(np.int64) * (len(rank) + 2) + _ahead(rank, owner, length) + 1
            found, rank = np.unique(joined, return_inverse=True)
            self.pairs.append((length, len(self.levels[-1]) + 2, found))
            length *= 2
        self.order = np.argsort(self.levels[-1], kind="stable")

    def test_ranks(self, hashes: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """For each length, the rank in this array of the words that every test suffix starts with, or -1 if it has none."""
        rank, out = _find(self.known, hashes), []
        for length, base, found in [*self.pairs, (0, 0, None)]:
            out.append(rank)
            if found is not None:
                ahead = _ahead(rank, owner, length)
                rank = np.where((rank >= 0) & (ahead >= 0), _find(found, rank * base + ahead + 1), -1)
        return out

    def common(self, ranks: list[np.ndarray], ends: np.ndarray, test: np.ndarray, train: np.ndarray) -> np.ndarray:
        """How many words test suffixes and train suffixes have in common from their start on; ``ends`` is of the test suffixes."""
        same = np.zeros(len(test), np.int64)
        room = np.minimum(ends[test] - test, self.ends[train] - train)
        # the longest length can fit more than once where ranks were unique before the full depth
        for level in [len(ranks) - 1] * (1 + int(room.max(initial=0)) // 2 ** (len(ranks) - 1)) + list(range(len(ranks) - 2, -1, -1)):
            step = 2**level
            at = np.flatnonzero(same + step <= room)
            fits = ranks[level][test[at] + same[at]]
            same[at[(fits >= 0) & (fits == self.levels[level][train[at] + same[at]])]] += step
        return same

    def place(self, ranks: list[np.ndarray], hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each test suffix belongs in the order of the train suffixes, by binary search."""
        test = np.arange(len(hashes))
        low, high = np.zeros(len(test), np.int64), np.full(len(test), len(self.order))
        first = np.searchsorted(self.known, hashes) * 2 - (ranks[0] < 0)  # words that the shard does not have lie between
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            train = self.order[middle]
            same = self.common(ranks, ends, open_, train)
            t, d = open_ + same, train + same
            ended = d >= self.ends[train]  # the shorter one comes first
            more = np.where(t < ends[open_], first[np.minimum(t, len(first) - 1)], -1)
            less = np.where(ended, -1, self.levels[0][np.minimum(d, len(self.owner) - 1)].astype(np.int64) * 2)
            after = less < more
            low[open_[after]] = middle[after] + 1
            high[open_[~after]] = middle[~after]
        return low

    def longest(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of the longest verbatim match of each test suffix, and where in the order a suffix with it stands."""
        if not len(hashes) or not len(self.order):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        ranks, ends, test = self.test_ranks(hashes, owner), np.searchsorted(owner, owner, "right"), np.arange(len(hashes))
        at = self.place(ranks, hashes, ends)
        before, behind = np.maximum(at - 1, 0), np.minimum(at, len(self.order) - 1)
        left, right = (self.common(ranks, ends, test, self.order[x]) for x in (before, behind))
        return np.maximum(left, right), np.where(left > right, before, behind)

    def matches(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``test, train, words`` of all verbatim matches of at least ``RUN`` words that cannot be longer on either side.

        The suffixes that start with the same ``RUN`` words stand together around the place of a test suffix."""
        words, beside = self.longest(hashes, owner)
        ranks, ends = self.test_ranks(hashes, owner), np.searchsorted(owner, owner, "right")
        test = np.flatnonzero(words >= RUN)
        if not len(test):
            return test, test, test
        run, beside = self._runs(), beside[test]
        low, high = np.searchsorted(run, run[beside], "left"), np.searchsorted(run, run[beside], "right")
        count = high - low
        train = self.order[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        test = np.repeat(test, count)
        begun = (test > 0) & (train > 0)
        begun &= (owner[test] == owner[test - 1]) & (self.owner[train] == self.owner[train - 1])
        shard = ranks[0][test - 1]
        begun &= (shard >= 0) & (shard == self.levels[0][train - 1])
        test, train = test[~begun], train[~begun]
        return test, train, self.common(ranks, ends, test, train)

    def _runs(self) -> np.ndarray:
        """A number for each place of the order that grows where the first ``RUN`` words change."""
        level = (RUN - 1).bit_length() - 1  # two halves of this length cover RUN words
        step = RUN - 2**level
        head = self.levels[min(level, len(self.levels) - 1)]
        tail = _ahead(head, self.owner, step)
        changed = (head[self.order][1:] != head[self.order][:-1]) | (tail[self.order][1:] != tail[self.order][:-1])
        return np.r_[0, np.cumsum(changed)]


def _ahead(rank: np.ndarray, owner: np.ndarray, step: int) -> np.ndarray:
    """The rank ``step`` words further in the same text, or -1."""
    ahead = np.full(len(rank), -1, np.int64)
    if step < len(rank):
        ahead[: len(rank) - step] = np.where(owner[step:] == owner[: len(owner) - step], rank[step:], -1)
    return ahead


def _find(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted distinct values, or -1."""
    at = np.minimum(np.searchsorted(values, wanted), max(0, len(values) - 1))
    return np.where(values[at] == wanted, at, -1) if len(values) else np.full(len(wanted), -1)


def held_words(matches: list[tuple[int, int, int]]) -> int:
    """The item's words held by the best one or two passages, from matches (place in item, place in document, words).

    Matches are taken in the order of their place in the document. Each continues the passage that began last of those
    that end at most ``GAP`` words before it, on either side, and that it leads further.
    """
    passages: list[list[int]] = []  # first and last word in the item, last word in the document, first in the document
    within: list[list[int]] = []  # the passages that a match can still continue, in the order of their start
    for t, d, n in sorted(matches, key=lambda m: (m[1], m[0])):
        within = [p for p in within if d - p[2] <= GAP + 1]
        for p in reversed(within):
            # the first RUN words of the match, from some word of it on, that lie behind the passage's end on both sides
            skip = max(0, p[1] - t - RUN + 2, p[2] - d - RUN + 2)
            if skip <= n - RUN and t + skip - p[1] <= GAP + 1 and d + skip - p[2] <= GAP + 1:
                p[1], p[2] = t + n - 1, d + n - 1
                break
        else:
            within.append([t, t + n - 1, d + n - 1, d])
            passages.append(within[-1])
    kept = [p for p in passages if p[1] - p[0] + 1 > SHARED]
    best = max((p[1] - p[0] + 1 for p in kept), default=0)
    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if b[0] > a[0] and b[3] > a[3]:
                best = max(best, b[1] - a[0] + 1 if b[0] <= a[1] else a[1] - a[0] + b[1] - b[0] + 2)
    return best


def _tests(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The items' words, the item of each, its place in the item, and the number of words of each item."""
    hashes, item = words([r.text for r in rows])
    sizes = np.bincount(item, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.r_[0, np.cumsum(sizes)[:-1]][item] if len(item) else np.zeros(0, np.int64)
    return hashes, item, place, sizes


def _shard_matches(texts: list[str], tests: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, item, item place, place, words`` of the matches in one shard."""
    hashes, owner = words(texts)
    test_hash, test_item, test_pos, sizes = tests
    if len(hashes) < RUN or not len(test_hash):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    test, train, n = SuffixArray(hashes, owner, int(sizes.max())).matches(test_hash, test_item)
    first = np.searchsorted(owner, owner, "left")
    return owner[train], test_item[test], test_pos[test], train - first[train], n


def _leaks(found: tuple, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (text, item) that hold enough, from a shard's matches."""
    text, item, place, train, n = found
    group = text * (len(sizes) + 1) + item
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    last = np.r_[first[1:], len(group)]
    # a match holds its words and at most GAP in front of it; whatever stays below the share even so is left out
    reach = np.add.reduceat(n[order] + GAP, first) if len(first) else first
    out = []
    for k in np.flatnonzero(reach >= SHARE * sizes[group[first] % (len(sizes) + 1)]) if len(first) else ():
        of = order[first[k] : last[k]]
        which = int(item[of[0]])
        if held_words(list(zip(place[of].tolist(), train[of].tolist(), n[of].tolist()))) >= SHARE * sizes[which]:
            out.append((int(text[of[0]]), which))
    return out


def _over_shards(documents: DataFrame, work, schema: str) -> DataFrame:
    """Rows of ``work(doc ids, texts)`` for each shard of the corpus, which is read once."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append(doc)
                texts.append(text)
                size += len(text)
                if size >= SHARD_CHARS:
                    yield work(docs, texts)
                    docs, texts, size = [], [], 0
        if texts:
            yield work(docs, texts)

    return spread(documents.where("text is not null").select("doc_id", "text")).mapInArrow(shards, schema)


def _few(items: DataFrame) -> bool:
    """Whether the items are few enough to be sent to every task."""
    return (items.agg(F.sum(F.length("text")).alias("n")).first().n or 0) <= MOST_ITEM_CHARS


def _items(items: DataFrame) -> DataFrame:
    return items.where("text is not null").select("item_id", "text").distinct()


def _ids(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def matches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, item_word, doc_word, words``: all verbatim matches of at least ``RUN`` words that cannot be longer,
    with the places of their first words."""
    items = _items(items)
    if not _few(items):
        return _by_row(items, lambda rows: _routed(documents, rows))
    rows = items.orderBy("item_id", "text").collect()
    tests, names = _tests(rows), ["doc_id", "item_id", "item_word", "doc_word", "words"]

    def work(docs: list, texts: list[str]) -> pa.RecordBatch:
        text, item, place, train, n = _shard_matches(texts, tests)
        of = [_ids([docs[i] for i in text]), _ids([rows[i].item_id for i in item]), _ids(place), _ids(train), _ids(n)]
        return pa.RecordBatch.from_arrays(of, names=names)

    return _over_shards(documents, work, ", ".join(f"{n} bigint" for n in names)).distinct()


def _by_row(items: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``find`` finds for each row of the items, by a hash of the row, since an id may have several texts."""
    rows = items.withColumn("row", F.xxhash64("item_id", "text"))
    found = find(rows.select(F.col("row").alias("item_id"), "text"))
    named = found.withColumnRenamed("item_id", "row").join(rows.select("row", "item_id"), "row")
    return named.select(*found.columns).distinct()


def _routed(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``matches`` for any number of items: the hashes of ``RUN`` words in a row meet in a join, then those that follow each other
    on both sides are one match."""

    def keyed(df: DataFrame, key: str) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, owner = words(batch.column("text").to_pylist())
                many = max(0, len(hashes) - RUN + 1)
                whole = np.flatnonzero(owner[:many] == owner[RUN - 1 :]) if many else np.zeros(0, np.int64)
                joined = np.zeros(len(whole), np.uint64)
                for k in range(RUN):
                    joined = (joined ^ hashes[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
                place = whole - np.searchsorted(owner, owner, "left")[whole] if len(whole) else whole
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner[whole])), pa.array(joined.view(np.int64)), _ids(place)], names=[key, "run", f"{key}_at"])

        return spread(df).mapInArrow(work, f"{key} bigint, run bigint, {key}_at bigint")

    wanted = keyed(items.select(F.col("item_id").alias("id"), "text"), "item").distinct()
    held = keyed(documents.where("text is not null").select(F.col("doc_id").alias("id"), "text"), "doc").distinct()
    hits = held.join(wanted, "run").withColumn("line", F.col("doc_at") - F.col("item_at"))
    line = Window.partitionBy("doc", "item", "line").orderBy("doc_at")
    hits = hits.withColumn("run", F.col("doc_at") - F.row_number().over(line))
    whole = hits.groupBy("doc", "item", "line", "run").agg(F.min("item_at").alias("item_word"), F.min("doc_at").alias("doc_word"), F.count("*").alias("n"))
    return whole.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "item_word", "doc_word", (F.col("n") + RUN - 1).alias("words"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: the documents that hold at least half of an item's words, with the item."""
    items = _items(items)
    if not _few(items):
        return _by_row(items, lambda rows: _routed_leaks(documents, rows))
    rows = items.orderBy("item_id", "text").collect()
    tests = _tests(rows)

    def work(docs: list, texts: list[str]) -> pa.RecordBatch:
        found = _leaks(_shard_matches(texts, tests), tests[3])
        return pa.RecordBatch.from_arrays([_ids([docs[d] for d, _ in found]), _ids([rows[i].item_id for _, i in found])], names=["doc_id", "item_id"])

    return _over_shards(documents, work, "doc_id bigint, item_id bigint").distinct()


def _routed_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _ids(np.bincount(words(batch.column("text").to_pylist())[1], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), sizes], names=["item_id", "size"])

    sizes = items.mapInArrow(count, "item_id bigint, size bigint")
    found = _routed(documents, items)
    enough = found.groupBy("doc_id", "item_id").agg(F.sum(F.col("words") + GAP).alias("reach")).join(sizes, "item_id")
    enough = enough.where(F.col("reach") >= SHARE * F.col("size")).select("doc_id", "item_id", "size")

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        held = held_words(list(zip(frame.item_word.tolist(), frame.doc_word.tolist(), frame.words.tolist())))
        return frame[["doc_id", "item_id"]].head(1 if held >= SHARE * frame["size"].iloc[0] else 0)

    return found.join(enough, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").applyInPandas(judge, "doc_id bigint, item_id bigint").distinct()


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a test item."""
    return documents.join(leaks(documents, items), "doc_id", "left_anti")
