"""Splitting of oversized items at natural boundaries with overlap (problem 4).

Recursive bisection: an item over the limit is cut at the strongest boundary near its middle, the halves again as long
as they exceed the limit less the overlap; each piece but the first then starts with the last tokens of the piece
before it. Cores without their overlaps, put together, are the item, character by character.

A token is a run of word characters or one other character that is not white space. Null, empty and blank texts give no
piece; items within the limit give one piece that is the whole text; repeated deliveries of one chunk count once; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import spread

LIMIT, OVERLAP = 512, 64
TOKEN = re.compile(r"\w+|[^\w\s]")
#: The same tokens in Java's syntax.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\p{Z}\x{1c}-\x{1f}]"
#: A boundary is sought this far from the middle, as a share of the span.
REACH = 0.3

_HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_ROW = re.compile(r"[ \t]*(?:\||[-*+•][ \t]|\d{1,3}[.)][ \t])")
_SENTENCE = re.compile(r"[.!?。？！][\"'”’)\]]*\s+(?=\S)")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
# strengths of boundaries, the strongest last
TOKEN_GAP, SPACE, LINE, SENTENCE, ROW, PARAGRAPH, HEADING = range(1, 8)


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """The strength of the boundary before each token, given the tokens' places, and the headings (place, level, title)."""
    strength = np.full(len(starts), TOKEN_GAP, np.int8)
    after_space = np.array([s > 0 and text[s - 1].isspace() for s in starts], bool)
    strength[after_space] = SPACE

    def mark(at: int, value: int) -> None:
        k = int(np.searchsorted(starts, at))
        if k < len(starts):
            strength[k] = max(strength[k], value)

    for m in _SENTENCE.finditer(text):
        mark(m.end(), SENTENCE)
    headings, at, blank, fenced = [], 0, False, False
    for line in text.split("\n"):
        if line.strip():
            heading = None if fenced else _HEADING.match(line)
            if heading:
                headings.append((at, len(heading[1]), heading[2]))
                mark(at, HEADING)
            elif blank:
                mark(at, PARAGRAPH)
            else:
                mark(at, ROW if fenced or _ROW.match(line) else LINE)
            fenced ^= bool(_FENCE.match(line))
            blank = False
        else:
            blank = True
        at += len(line) + 1
    return strength, headings


def bisect(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """The tokens at which the pieces of an item start, the first included."""
    cuts, spans = [], [(0, len(strength))]
    while spans:
        first, last = spans.pop()
        size = last - first
        if size <= (limit if size == len(strength) else limit - overlap):
            cuts.append(first)
            continue
        middle, reach = (first + last) / 2, max(1, int(size * REACH))
        low = max(first + 1, int(middle) - reach)
        window = strength[low : min(last, int(middle) + reach + 1)]
        best = np.flatnonzero(window == window.max())
        cut = low + int(best[np.abs(best + low - middle).argmin()])
        spans += [(cut, last), (first, cut)]
    return cuts


def hierarchy_at(base: list[str], headings: list[tuple[int, int, str]], at: int) -> list[str]:
    """The headings that hold at a place: the item's own, replaced from each level on by headings inside it."""
    held = list(base)
    for place, level, title in headings:
        if place > at:
            break
        held = [*held[: level - 1], title]
    return held


def split_item(text: str, base: list[str], limit: int, overlap: int) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """Each piece of ``text``: start with overlap, start of the core, end, tokens, headings at the core's start."""
    tokens = np.array([m.span() for m in TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    if not len(tokens):
        return
    strength, headings = boundaries(text, tokens[:, 0])
    cuts = bisect(strength, limit, overlap)
    for k, cut in enumerate(cuts):
        stop = cuts[k + 1] if k + 1 < len(cuts) else len(tokens)
        before = max(cuts[k - 1], cut - overlap) if k else cut
        core = int(tokens[cut, 0]) if k else 0
        start = int(tokens[before, 0]) if k else 0
        end = int(tokens[stop, 0]) if stop < len(tokens) else len(text)
        yield start, core, end, stop - before, hierarchy_at(base, headings, int(tokens[cut, 0]))


def token_count(text):
    """The number of tokens of a text column; texts that are too short to exceed any limit are counted all the same."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id, text, heading_hierarchy`` of each chunk once; repeated deliveries agree in these fields."""
    kept = chunks.where("text is not null").groupBy("chunk_id")
    row = F.max_by(F.struct("text", "heading_hierarchy"), F.struct("ingested_at", "text")).alias("row")
    return kept.agg(row).select("chunk_id", "row.text", "row.heading_hierarchy")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The chunks of more than ``limit`` tokens. Only they are shuffled, to drop repeated deliveries."""
    over = (F.length("text") > limit) & (token_count(F.col("text")) > limit)
    return distinct_chunks(chunks.where(over))


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, piece_no, text, token_count, start_char, core_char, end_char, heading_hierarchy`` of all pieces of the
    oversized chunks. Offsets count characters from the start of the chunk; ``core_char`` is where the overlap ends."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                base = [x for x in row.heading_hierarchy if x is not None] if row.heading_hierarchy is not None else []
                cut = split_item(row.text, base, limit, overlap)
                rows = [(row.chunk_id, k, row.text[a:z], n, a, c, z, h) for k, (a, c, z, n, h) in enumerate(cut)]
                yield pd.DataFrame(rows, columns=names)

    schema = (
        "chunk_id string, piece_no int, text string, token_count int, start_char int, core_char int, end_char int, "
        "heading_hierarchy array<string>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return spread(oversized(chunks, limit)).mapInPandas(work, schema)


def oversized_ids(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id`` of every chunk that the operator cuts."""
    return pieces(chunks, limit, overlap).where("piece_no > 0").select("chunk_id").distinct()
