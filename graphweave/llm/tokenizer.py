"""Encoding of whole texts with a public byte-level BPE tokenizer (problem 6).

Spark splits every text into words; each task encodes the words that are new to it with one recursive DuckDB query:
rows of (word, position, token) join the merge table, each word contracts its pairs of lowest rank from the left, until
no word has a pair left. An ordered aggregation then puts the documents' ids together.

A round contracts, besides a word's pairs of lowest rank, every pair that no earlier merge can break: nothing that the token before
it can become the end of merges with its left token at a lower rank, and the same holds behind it.
A merge's rank is higher than those of both its parts, so the order of all merges would contract the same pairs. Words are
first cut between bytes that stand together in no token, and the query keeps one row a token, not one a round, so words may
be long.

Null and empty texts have the empty list. Special tokens are never produced; their strings are ordinary text. Extra
columns are ignored, repeated rows are encoded each, an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import spread

#: Where the vocabulary files lie; a parameter of every function here.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published word pattern of this vocabulary, with Java's flag for Unicode white space.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and bytes that one DuckDB query takes, and known words and bytes that a task keeps: bounds of a worker's memory. A
#: longer word is a query of its own.
WORDS_A_QUERY, BYTES_A_QUERY, WORDS_KEPT, BYTES_KEPT = 400_000, 8_000_000, 1_500_000, 64_000_000

_ENCODE = """
INSERT INTO known
WITH RECURSIVE tokens(word, pos, tok) USING KEY (word, pos) AS (
    SELECT f.word, b.pos, s.tok
    FROM fresh f, UNNEST(f.bytes) WITH ORDINALITY AS b(byte, pos) JOIN symbols s ON s.byte = b.byte
  UNION
    SELECT word, unnest([pos, nxt_pos]), unnest([made, -1])
    FROM (
        SELECT *, (n - min(n) OVER run) % 2 AS odd, first_value(goes_on) OVER run AS undecided
        FROM (
            SELECT *, n - row_number() OVER (PARTITION BY word, rank ORDER BY n) AS run_no
            FROM (
                SELECT p.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY p.word) AS lowest, coalesce(l.rank, m.rank) AS left_rank,
                       coalesce(r.rank, m.rank) AS right_rank
                FROM (
                    SELECT word, pos, tok, row_number() OVER w AS n, lead(tok) OVER w AS nxt, lead(pos) OVER w AS nxt_pos,
                           lag(tok) OVER w AS before, lead(tok, 2) OVER w AS after,
                           coalesce(lag(tok) OVER w = tok AND tok = lead(tok) OVER w, false) AS goes_on
                    FROM recurring.tokens SEMI JOIN (SELECT DISTINCT word FROM tokens) USING (word) WHERE tok >= 0
                    WINDOW w AS (PARTITION BY word ORDER BY pos)
                ) p JOIN merges m ON m.a = p.tok AND m.b = p.nxt
                LEFT JOIN left_ranks l ON l.tok = p.tok AND l.beside = p.before LEFT JOIN right_ranks r ON r.tok = p.nxt AND r.beside = p.after
            ) WHERE rank = lowest OR (rank <= left_rank AND rank <= right_rank)
        ) WINDOW run AS (PARTITION BY word, rank, run_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    ) WHERE odd = 0 AND NOT undecided
)
SELECT w.text, ids FROM (
    SELECT f.owner, list(t.tok ORDER BY t.word, t.pos) AS ids FROM tokens t JOIN fresh f USING (word) WHERE t.tok >= 0 GROUP BY f.owner
) JOIN words w USING (owner)
"""


@dataclass(frozen=True)
class Merges:
    """A tokenizer's tables: the symbol of each byte, and for each mergeable pair its rank and the token it makes."""

    symbols: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def load(path: str = DEFAULT_VOCABULARY) -> Merges:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocabulary = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}
        symbols = np.array([vocabulary[letter[b]] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        rows = [(vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)]
        return Merges(symbols, np.array(rows, np.int32).reshape(-1, 4))

    def side_ranks(self, side: int) -> pa.Table:
        """``tok, beside, rank``: the lowest rank at which a token merges with one on its left (0) that is ``beside`` or has it as
        its end, or with one on its right (1) that is ``beside`` or has it as its start. Where the merges' order is not that
        of their parts, or a token is made in two ways, every rank is -1: only pairs of the lowest rank are contracted then."""
        left, right, rank, made = self.pairs.T
        born = np.full(1 + int(max(self.pairs[:, [0, 1, 3]].max(initial=0), self.symbols.max(initial=0))), -1)
        born[made] = rank
        sound = (np.maximum(born[left], born[right]) < rank).all() and len(np.unique(made)) == len(made)
        part = np.full(len(born), -1)
        part[made] = left if side else right
        (tok, beside), out = (left, right) if side else (right, left), []
        while len(tok):
            out.append(np.stack([tok, beside, rank if sound else 0 * rank - 1], 1))
            beside = part[beside]
            tok, rank, beside = tok[beside >= 0], rank[beside >= 0], beside[beside >= 0]
        rows = np.concatenate(out or [np.zeros((0, 3), np.int64)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)] if len(rows) else np.zeros(0, bool)
        return pa.table({k: rows[first, i].copy() for i, k in enumerate(("tok", "beside", "rank"))})

    def crossed(self) -> np.ndarray:
        """Whether some token has a byte (row) followed by another (column)."""
        ends = {int(t): (b, b) for b, t in enumerate(self.symbols)}
        out = np.zeros((256, 256), bool)
        for a, b, _, made in self.pairs.tolist():
            if a in ends and b in ends:
                out[ends[a][1], ends[b][0]] = True
                ends[made] = ends[a][0], ends[b][1]
        return out


class _Encoder:
    """One task's DuckDB connection with the merge table and the words encoded so far."""

    def __init__(self, merges: Merges) -> None:
        import duckdb

        # no spill: what a query takes is bounded, and a task has no folder of its own on a cluster
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        tables = {
            "symbols": pa.table({"byte": pa.array(range(256), pa.int32()), "tok": merges.symbols}),
            "merges": pa.table({k: merges.pairs[:, i].copy() for i, k in enumerate(("a", "b", "rank", "made"))}),
            "left_ranks": merges.side_ranks(0), "right_ranks": merges.side_ranks(1),
        }
        for name, rows in tables.items():
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
        self.db.execute("CREATE TABLE known (text VARCHAR, ids INTEGER[])")
        self.crossed, self.words, self.bytes = merges.crossed(), 0, 0

    def encode(self, texts: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """The ids of the words of each document in ``docs``, which is ascending."""
        rows = pa.table({"pos": pa.array(np.arange(len(texts))), "doc": docs, "text": texts})
        new = self.db.sql("SELECT DISTINCT text FROM rows ANTI JOIN known USING (text)").to_arrow_table()["text"]
        if self.words + len(new) > WORDS_KEPT or self.bytes > BYTES_KEPT:
            self.db.execute("DELETE FROM known")
            new, self.words, self.bytes = self.db.sql("SELECT DISTINCT text FROM rows").to_arrow_table()["text"], 0, 0
        if len(new):
            new = new.combine_chunks() if isinstance(new, pa.ChunkedArray) else new
            raw = new.cast(pa.binary())
            spans = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[spans[0] : spans[-1]]
            starts = np.union1d(spans[:-1] - spans[0], 1 + np.flatnonzero(~self.crossed[data[:-1], data[1:]]))
            owner = np.searchsorted(spans - spans[0], starts, "right") - 1
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(data)].astype(np.int32)), pa.array(data.astype(np.int32)))
            self.db.register("fresh", pa.table({"word": pa.array(np.arange(len(starts))), "owner": owner, "bytes": lists}))
            self.db.register("words", pa.table({"owner": pa.array(np.arange(len(new))), "text": new}))
            self.db.execute(_ENCODE)
            self.db.unregister("fresh")
            self.db.unregister("words")
            self.words, self.bytes = self.words + len(new), self.bytes + len(data)
        found = self.db.sql(
            "SELECT doc, flatten(list(ids ORDER BY pos)) AS ids FROM rows JOIN known USING (text) GROUP BY doc ORDER BY doc"
        ).to_arrow_table()
        assert rows.num_rows >= found.num_rows
        return found["doc"].to_numpy(), found["ids"].combine_chunks()


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, ids``: one row with the token ids of each row of ``documents``."""
    merges = Merges.load(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(merges)
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy()
            words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            docs = np.repeat(np.arange(len(lists)), np.diff(offsets))
            parts: list[list[np.ndarray]] = [[] for _ in range(len(lists))]
            upto, at = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)), 0
            while at < len(words):
                began, fit = at, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES_A_QUERY, "right"))
                at = max(at + 1, min(at + WORDS_A_QUERY, fit))
                own, ids = encoder.encode(words.slice(began, at - began), docs[began:at])
                spans, values = ids.offsets.to_numpy(), ids.values.to_numpy()
                for k, doc in enumerate(own):
                    parts[doc].append(values[spans[k] : spans[k + 1]])
            sizes = [sum(map(len, p)) for p in parts]
            flat = np.concatenate([x for p in parts for x in p] or [np.empty(0)]).astype(np.int32)
            spans = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(spans), pa.array(flat))], names=["doc_id", "ids"]
            )

    words = F.coalesce(F.expr(f"regexp_extract_all(text, r\"{WORD_PATTERN}\", 0)"), F.array().cast("array<string>"))
    return (
        spread(documents.select("doc_id", "text"))
        .select("doc_id", words.alias("words"))
        .mapInArrow(encode, "doc_id bigint, ids array<int>")
    )
