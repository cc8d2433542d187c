"""Sections, sentences, greedy packing with overlap, chunk ids and offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.errors import ChunkingError
from graphweave.functions.text import TOKEN, strip, token_count

# Heading lines, sentence ends, table blocks.
HEADING = r"^(#{1,6})[\s\x0B\x{85}\p{Z}]+(.+)\z"
SENTENCE_END = r"(?<=[.!?])[\s\x0B\x{85}\p{Z}]+(?=[A-Z])|(?<=\n\n)"
TABLE_BLOCK = r"(?md)(?:^\|.+\|$\n?)+"
_MARK = "\x01"


def sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section_no, heading_hierarchy, body_text, start_char``: the stretches between headings.

    One shuffle on the document key serves all windows. Text before the first heading is section 0 with no headings. A
    heading replaces all headings of its level or deeper. Null texts have no sections.
    """
    rows = documents.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    stripped = strip(F.col("line"))
    level = F.length(F.regexp_extract(stripped, HEADING, 1))
    title = strip(F.regexp_extract(stripped, HEADING, 2))
    rows = rows.withColumns({"level": F.when(stripped.rlike(HEADING), level), "title": title})
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    held = []
    for n in range(1, 7):
        last = F.max(F.when(F.col("level") == n, F.struct("pos", "title"))).over(upto)
        higher = F.coalesce(F.max(F.when(F.col("level") < n, F.col("pos"))).over(upto), F.lit(-1))
        held.append(F.when(last["pos"] > higher, last["title"]))
    rows = rows.withColumns(
        {
            "section_no": F.count("level").over(upto).cast("int"),
            "start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)),
            "held": F.filter(F.array(*held), lambda x: x.isNotNull()),
        }
    )
    body = F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))
    return rows.groupBy(key, "section_no").agg(
        F.min_by("held", "pos").alias("heading_hierarchy"),
        F.array_join(F.transform(F.array_sort(body), lambda x: x["line"]), "\n").alias("body_text"),
        F.min("start").cast("int").alias("start_char"),
    )


def prefixed(parts: DataFrame) -> DataFrame:
    """Sections with a body, their text led by the headings in brackets."""
    lead = F.when(F.size("heading_hierarchy") > 0, F.concat(F.lit("["), F.array_join("heading_hierarchy", " > "), F.lit("]\n")))
    parts = parts.where(strip(F.col("body_text")) != "")
    return parts.withColumn("text", F.concat(F.coalesce(lead, F.lit("")), "body_text"))


def units(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section_no, unit_no, unit, tokens``: sentences, and table blocks that stay whole."""
    tables = F.regexp_extract_all("text", F.lit(TABLE_BLOCK), F.lit(0))
    between = F.split("text", TABLE_BLOCK)
    # text and tables alternate, the text first
    mixed = F.flatten(
        F.zip_with(between, tables, lambda a, t: F.concat(F.split(a, SENTENCE_END), F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(t))))
    )
    found = F.filter(F.transform(mixed, strip), lambda x: x != "")
    rows = parts.select(key, "section_no", F.posexplode(found).alias("unit_no", "unit"))
    return rows.withColumn("tokens", token_count(F.col("unit")))


def pack(tokens: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Stretches [first, last) of units that are packed together, in order.

    Units are added while they fit, the first always does. The next stretch starts with as many last units as have at most
    ``overlap`` tokens, unless they and the next unit do not fit: then it starts behind, so that it always gets on.
    """
    out, first = [], 0
    while first < len(tokens):
        last, total = first + 1, tokens[first]
        while last < len(tokens) and total + tokens[last] <= size:
            total += tokens[last]
            last += 1
        out.append((first, last))
        if last >= len(tokens):
            break
        back, carried = last, 0
        while back - 1 > first and carried + tokens[back - 1] <= overlap:
            back -= 1
            carried += tokens[back]
        first = back if carried + tokens[last] <= size else last
    return out


_TOKEN = regex.compile(TOKEN.replace(r"\x{85}", r"\x85"))


def force_split(text: str, size: int) -> list[str]:
    """A unit over the size, cut after every ``size`` tokens."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    cuts = [*starts[::size], len(text)]
    return [x for x in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if x]


def packed(rows: DataFrame, size: int, overlap: int, key: str = "doc_id", cut: bool = True) -> DataFrame:
    """``key, section_no, part_no, text, first_unit`` from units; with ``cut`` units over the size are cut first.

    A section is one row here, an array of its sentences, so packing is a projection; it goes to Python by Arrow.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ChunkingError("the size must be positive and the overlap less than it")
    ordered = F.array_sort(F.collect_list(F.struct("unit_no", "unit", "tokens")))
    grouped = rows.groupBy(key, "section_no").agg(ordered.alias("units"))
    kind = dict(grouped.dtypes)[key]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, section, parts in zip(frame[key], frame["section_no"], frame["units"]):
                flat = []
                for u in parts:
                    flat += [(u["unit"], u["tokens"])] if u["tokens"] <= size or not cut else [(x, len(_TOKEN.findall(x))) for x in force_split(u["unit"], size)]
                for n, (a, b) in enumerate(pack([t for _, t in flat], size, overlap)):
                    out.append((k, section, n, "\n".join(x for x, _ in flat[a:b]), flat[a][0]))
            yield pd.DataFrame(out, columns=[key, "section_no", "part_no", "text", "first_unit"])

    return grouped.mapInPandas(work, f"{key} {kind}, section_no int, part_no int, text string, first_unit string")


# the patterns of the column functions above, for text that is in a task already
_WS = r"[\s\x0B\x85\p{Z}]"
_HEADING = regex.compile(rf"(#{{1,6}}){_WS}+([^\n\r\x85\u2028\u2029]+)")
_SENTENCE_END = regex.compile(rf"(?<=[.!?]){_WS}+(?=[A-Z])|(?<=\n\n)")
_TABLE = regex.compile(r"(?m)(?:^\|[^\n]+\|$\n?)+")
_ENDS = regex.compile(rf"\A{_WS}+|{_WS}+\Z")


def _sections(text: str) -> Iterator[tuple[list[str], str, int]]:
    """``headings, body, start`` of the stretches between headings, as ``sections`` has them."""
    held: dict[int, str] = {}
    body, start, at, begun = [], 0, 0, False
    for line in text.split("\n"):
        found = _HEADING.fullmatch(_ENDS.sub("", line))
        if found:
            if begun:
                yield [held[n] for n in sorted(held)], "\n".join(body), start
            level = len(found[1])
            held = {n: t for n, t in held.items() if n < level} | {level: _ENDS.sub("", found[2])}
            body, start = [], at
        else:
            body.append(line)
        begun, at = True, at + len(line) + 1
    yield [held[n] for n in sorted(held)], "\n".join(body), start


def _units(text: str) -> list[str]:
    """Sentences, and table blocks that stay whole, as ``units`` has them."""
    out, at = [], 0
    for table in _TABLE.finditer(text):
        out += [*_SENTENCE_END.split(text[at : table.start()]), table[0]]
        at = table.end()
    out += _SENTENCE_END.split(text[at:])
    return [x for x in (_ENDS.sub("", u) for u in out if u) if x]


def document_parts(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int, list[str]]]:
    """``text, tokens, start, headings`` of a document's chunks in order.

    Each section with a body is led by its headings in brackets, cut into units, oversized ones of them after every ``size``
    tokens, and packed. The start is where the first 50 characters of the first unit stand from the section's start on, else
    the section's start."""
    for headings, body, start in _sections(text):
        if not _ENDS.sub("", body):
            continue
        lead = f"[{' > '.join(headings)}]\n" if headings else ""
        flat = []
        for unit in _units(lead + body):
            tokens = len(_TOKEN.findall(unit))
            flat += [(unit, tokens)] if tokens <= size else [(x, len(_TOKEN.findall(x))) for x in force_split(unit, size)]
        for a, b in pack([n for _, n in flat], size, overlap):
            joined = "\n".join(x for x, _ in flat[a:b])
            found = text.find(flat[a][0][:50], start)
            yield joined, len(_TOKEN.findall(joined)), found if found >= 0 else start, headings


def chunk(documents: DataFrame, size: int = 512, overlap: int = 64, key: str = "file_hash", id_width: int = 12) -> DataFrame:
    """``key, chunk_id, chunk_index, text, token_count, start_char, end_char, heading_hierarchy, repeated``.

    A document is one row from its sections to its chunks, so nothing is shuffled; keys must be unique. Offsets are
    approximate, since chunk texts are joined again. ``repeated`` tells that an earlier chunk of the document has the same
    text. Ids start with ``id_width`` characters of the key: 12 as in the format, more where millions of files make such
    starts collide. Null texts have no chunks.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ChunkingError("the size must be positive and the overlap less than it")
    kind = dict(documents.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                seen: set[str] = set()
                for index, (part, tokens, start, headings) in enumerate(document_parts(text, size, overlap)):
                    bare = _ENDS.sub("", part)
                    rows.append((name, f"{str(name)[:id_width]}_{index:04d}", index, part, tokens, start, start + len(part), headings, bare in seen))
                    seen.add(bare)
            columns = zip(*rows) if rows else [()] * len(_CHUNK)
            types = [batch.schema.field(key).type, *_CHUNK.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)] if rows else [pa.array([], t) for t in types], names=[key, *_CHUNK])

    schema = f"{key} {kind}, chunk_id string, chunk_index int, text string, token_count int, start_char int, end_char int, heading_hierarchy array<string>, repeated boolean"
    return documents.where(F.col("text").isNotNull()).select(key, "text").mapInArrow(work, schema)


_CHUNK = {
    "chunk_id": pa.string(), "chunk_index": pa.int32(), "text": pa.string(), "token_count": pa.int32(), "start_char": pa.int32(),
    "end_char": pa.int32(), "heading_hierarchy": pa.list_(pa.string()), "repeated": pa.bool_(),
}

__all__ = ["HEADING", "SENTENCE_END", "TOKEN", "chunk", "document_parts", "force_split", "pack", "packed", "prefixed", "sections", "units"]
