"""Noise in text from scanned pages, and its repair (problem 5).

One pass reads every chunk's lines and notes lines that may be running headers, page numbers, words broken over line
ends, words that the corpus's born-digital chunks do not know, and word counts. The rest is SQL: headers recur in their
file; a lone number above the file's page count is no page number, unless the file's pages refute the count; a break is real if
the corpus knows the joined word rather than the compound; a rare word is misread if its anagram hash differs from a frequent
word's by the difference of one or two confusable strings. Confusable are the strings of a built-in list and those that
the corpus itself shows: the differences between its rare and frequent words that occur in many words.

Null, empty and blank texts have no noise. Repeated deliveries of a chunk count once. Ties between corrections go to the
fewest confusions, then the most frequent word, then the alphabet. Empty tables give empty results, extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import checkpointed, spread

# What recognition makes of letters, as (wrong, right).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("0", "o"), ("o", "a"), ("a", "o"), ("5", "s"), ("ri", "n"), ("n", "ri"),
    ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("q", "g"), ("g", "q"),
    ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("6", "b"), ("vv", "w"), ("w", "vv"), ("8", "b"), ("li", "h"), ("9", "g"),
]
#: A misread word is at least so many times rarer than its correction; a header recurs in so many chunks of its file, and so
#: many different page numbers refute a page count.
RARER, RECURS = 10, 2
#: A difference is learned as a confusion if it is between so many rare and frequent words, and at least this share of
#: the number of the most frequent difference. Shares keep the list short: in a corpus chance differences are far below.
LEAST_LEARNED, LEARNED_SHARE = 5, 0.04
_MARKS = "-‐¬\xad"
_BROKEN = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{_MARKS}])[ \t]*$")
_RIGHT = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = r"[0-9lIoO]{1,4}"
_PAGE = re.compile(
    rf"\s*(?:(?:p[a@]g[ec]|seite|s[.]|pg[.]?|pp?[.]?)\s*{_NUMBER}(?:\s*(?:of|/|von)\s*{_NUMBER})?|{_NUMBER}\s*(?:/|of)\s*{_NUMBER}"
    rf"|([-–—~*•|=_·.<(\[])\s*{_NUMBER}\s*[-–—~*•|=_·.>)\]]|{_NUMBER}\s*\||\|\s*{_NUMBER})\s*",
    re.I,
)
_BARE = re.compile(r"\s*(?:\d{1,4}|[ivxlc]{1,7})\s*", re.I)
_BODY = re.compile(r"\||[ \t]*[-*+] |```|\w+\(|#{1,6} |\[.*\]$")
_ABBREVIATED = re.compile(r"\b(?:inc|ltd|co|corp|llc|no)\.$", re.I)
_LETTERS, _INSIDE = re.compile(r"[^\W\d_][^\W_]*"), re.compile(r"(\w+)[.?!:;,] +\w")
_STRONG = re.compile(r"©|·| — |^\s*\d+ \| |\s{3}\d+\s*$")
_FOLD = [("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d")]
_FOLD_LETTERS = str.maketrans("e" "0a" "f" "1l" "5" "q9" "6b8", "c" "oo" "t" "ii" "s" "gg" "hhh")
_PAGE_IN_HEADER = re.compile(r"^\s*\d+ \| |\s{2,}\d+\s*$|(?<![^\s.])\d[\d.]*(?![^\s.])")


def fold_line(line: str) -> str:
    """What is left of a line when numbers, marks, case and confusable characters do not count."""
    key = _PAGE_IN_HEADER.sub(" ", line).lower()
    for wrong, right in _FOLD:
        key = key.replace(wrong, right)
    return re.sub(r"[^a-zà-ɏ]+", "", key.translate(_FOLD_LETTERS))


def _titled(line: str) -> bool:
    """The words of some length start with capitals, and no sentence ends in the line."""
    if line.lstrip()[:1].islower() or (line[-1:] in tuple(".?!:;,") and not _ABBREVIATED.search(line)):
        return False
    words = [w for w in _LETTERS.findall(line) if len(w) > 3]
    if not words or len(words) > 9:
        return False
    capitals = sum(w[0].isupper() or w[0].isdigit() for w in words)
    if capitals < (0.5 if _STRONG.search(line) else 1.0) * len(words):
        return False
    return all(m[1].lower() in ("inc", "ltd", "co", "corp", "llc", "no") for m in _INSIDE.finditer(line))


class Lines:
    """A chunk's lines with the role of each: body, header candidate or page number."""

    def __init__(self, text: str, hierarchy: list[str]) -> None:
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.titles = {fold_line(x) for x in hierarchy if x}
        first = 1 if self.lines and self.lines[0].startswith("[") and self.lines[0].rstrip().endswith("]") else 0
        self.role = ["prefix" if i < first else "body" if x.strip() else "blank" for i, x in enumerate(self.lines)]
        for i, line in enumerate(self.lines):
            if self.role[i] == "body" and len(line) < 40 and _PAGE.fullmatch(line):
                self.role[i] = "page"
        prose = [len(x.rstrip()) for x, r in zip(self.lines, self.role) if r == "body" and not _BODY.match(x)]
        self.width = max(prose, default=0)
        wide = sum(n >= 0.7 * self.width for n in prose)
        self.wrapped = 30 <= self.width <= 130 and len(prose) >= 2 and wide >= 0.5 * len(prose)
        self.strong = [False] * len(self.lines)
        if self.wrapped:
            self._mark()

    def _mark(self) -> None:
        numeric = [bool(_BARE.fullmatch(x)) and r != "blank" for x, r in zip(self.lines, self.role)]
        spot = [i for i, r in enumerate(self.role) if r not in ("blank", "prefix")]
        for i in spot:
            line = self.lines[i].rstrip()
            beside = numeric[max(0, i - 1)] * (i > 0) + (i + 1 < len(numeric) and numeric[i + 1])
            if self.role[i] == "body" and numeric[i] and not beside and not (i and self.lines[i - 1].rstrip().endswith(":")):
                self.role[i] = "page"
        for i in spot:
            line = self.lines[i].rstrip()
            if self.role[i] != "body" or _BODY.match(line) or not _titled(line):
                continue
            follow = next((self.lines[j].split() for j in range(i + 1, len(self.lines)) if self.lines[j].strip()), [])
            fits = not follow or len(line) + 1 + len(follow[0]) <= self.width
            beside = any(0 <= j < len(self.role) and self.role[j] == "page" for j in (i - 1, i + 1))
            self.strong[i] = bool(_STRONG.search(line)) or fold_line(line) in self.titles or line.isupper() or (beside and fits)
            if fits or i in (spot[0], spot[-1]) or self.strong[i]:
                self.role[i] = "head"


def _page_note(file: str, chunk: str, i: int, line: str) -> tuple:
    number = re.search(r"\d{1,9}", line)
    return "page", file, chunk, i, line, "bare" if _BARE.fullmatch(line) else None, int(number[0]) if number else 0


def _notes(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows ``kind, file_hash, chunk_id, line, a, b, n`` of one batch of chunks."""
    digital: Counter[str] = Counter()
    scanned: Counter[str] = Counter()
    unsure: list[tuple[str, str, int, str]] = []
    columns = (batch.column(n).to_pylist() for n in ("file_hash", "chunk_id", "text", "heading_hierarchy"))
    for file, chunk, text, hierarchy in zip(*columns):
        parsed = Lines(text, hierarchy or [])
        if not parsed.wrapped:
            digital.update(_WORD.findall(text.lower()))
            for i, role in enumerate(parsed.role):
                if role == "page":
                    yield _page_note(file, chunk, i, parsed.lines[i])
            continue
        body = [(i, x) for i, x in enumerate(parsed.lines) if parsed.role[i] in ("body", "head")]
        carried = ""
        for i, line in body:
            if parsed.role[i] == "head":
                yield "head", file, chunk, i, fold_line(line), line, int(parsed.strong[i])
                words = _WORD.findall(line.lower())
            else:
                if carried:
                    right = _RIGHT.match(line)
                    if right and right[0][0].islower():
                        left, mark = carried[:-1], carried[-1]
                        yield "break", file, chunk, i, left.lower() + "|" + right[0].lower(), mark, 1
                        whole = (left.rpartition("-")[2] + right[0]).lower()
                        scanned[whole] += 1
                        unsure.append((file, chunk, i, whole))
                        line = line[right.end() :]
                    carried = ""
                broken = _BROKEN.search(line) if line.rstrip(" \t").endswith(tuple(_MARKS)) else None
                if broken:
                    carried = broken[1] + broken[2]
                    line = line[: broken.start()]
                words = _WORD.findall(line.lower())
            scanned.update(words)
            unsure += [(file, chunk, i, w) for w in words]
        for i, role in enumerate(parsed.role):
            if role == "page":
                yield _page_note(file, chunk, i, parsed.lines[i])
    for word, n in digital.items():
        yield "digital", None, None, None, word, None, n
    for word, n in scanned.items():
        yield "scanned", None, None, None, word, None, n
    for file, chunk, i, word in unsure:
        if word not in digital and not word.isdigit():
            yield "word", file, chunk, i, word, None, 1


_NOTE = pa.schema([("kind", pa.string()), ("file_hash", pa.string()), ("chunk_id", pa.string()), ("line", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def notes(chunks: DataFrame) -> DataFrame:
    """All notes of the one pass over the chunks, written to the checkpoint folder since several steps read them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_notes(batch))
            columns = zip(*rows) if rows else [()] * len(_NOTE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NOTE)], schema=_NOTE)

    texts = chunks.where("text is not null").select("file_hash", "chunk_id", "text", "heading_hierarchy")
    schema = "kind string, file_hash string, chunk_id string, line int, a string, b string, n bigint"
    return checkpointed(spread(texts).mapInArrow(work, schema))


def headers(found: DataFrame) -> DataFrame:
    """``chunk_id, line``: header candidates that recur in their file or whose form or place leaves no doubt."""
    heads = found.where("kind = 'head'")
    often = heads.where("a != ''").groupBy("file_hash", "a").agg(F.count_distinct("chunk_id").alias("chunks"))
    return heads.join(often, ["file_hash", "a"], "left").where((F.col("n") == 1) | (F.col("chunks") >= RECURS)).select("chunk_id", "line").distinct()


def anagram_hash(word):
    """The sum of the fifth powers of a word column's characters: equal for all orders of the same characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", 0).otherwise(F.pow(F.ascii(c).cast("double"), F.lit(5.0)).cast("bigint")))


def _vocabulary(found: DataFrame) -> DataFrame:
    """``word, digital, total``: how often born-digital chunks, and all chunks, have each word."""
    counts = found.where("kind in ('digital', 'scanned')").groupBy(F.col("a").alias("word"))
    return counts.agg(F.sum(F.when(F.col("kind") == "digital", F.col("n")).otherwise(0)).alias("digital"), F.sum("n").alias("total"))


def pages(found: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """``chunk_id, line`` of the page numbers. ``metadata`` has ``file_hash, page_count, ingested_at``: a line of nothing but a number
    above the current page count of its file is left out, unless other numbers of the file are above it as well. Null and 0
    are no counts."""
    page = found.where("kind = 'page'")
    if metadata is None:
        return page.select("chunk_id", "line")
    counts = metadata.groupBy("file_hash").agg(F.max_by(F.struct("page_count"), "ingested_at")["page_count"].alias("page_count"))
    above = page.join(counts.where("page_count > 0"), "file_hash").where(F.col("n") > F.col("page_count"))
    refuted = above.groupBy("file_hash").agg(F.count_distinct("n").alias("numbers")).where(F.col("numbers") >= RECURS)
    doubted = above.where("b = 'bare'").join(refuted, "file_hash", "left_anti").select("chunk_id", "line")
    return page.select("chunk_id", "line").join(doubted, ["chunk_id", "line"], "left_anti")


def _spans(words: DataFrame, name: str) -> DataFrame:
    """Every one or two letters of a word, with what stands before and behind them."""
    size = F.length("word")
    at = F.expr("flatten(transform(array(1, 2), n -> transform(sequence(1, length(word) - n + 1), i -> struct(i AS i, n AS n))))")
    rows = words.where(size >= 4).withColumn("s", F.explode(at))
    return rows.select(
        *words.columns, F.expr("substring(word, 1, s.i - 1)").alias("head"), F.expr("substring(word, s.i + s.n)").alias("tail"), F.expr("substring(word, s.i, s.n)").alias(name),
    )


def confusions(rare: DataFrame, known: DataFrame) -> DataFrame:
    """``wrong, right, change``: the built-in confusions and the learned ones, with the difference of their anagram hashes.

    ``rare`` has ``word, own`` and ``known`` has ``word, total``. Learned are differences of at most two letters in one place, counted over the
    rare words that differ so from a word ``RARER`` times as frequent; an equality join on what stands around the place.
    """
    a = _spans(rare.select("word", "own"), "wrong")
    b = _spans(known.select("word", "total"), "right").withColumnRenamed("word", "correct")
    edge = F.expr("(length(wrong) > 1 OR length(right) > 1) AND (substring(wrong, 1, 1) = substring(right, 1, 1) OR right(wrong, 1) = right(right, 1))")
    met = a.join(b, ["head", "tail"]).where((F.col("wrong") != F.col("right")) & (F.col("total") >= RARER * F.col("own")) & ~edge)
    counted = checkpointed(met.groupBy("wrong", "right").agg(F.count_distinct("word").alias("n")))
    most = counted.agg(F.max("n").alias("most")).first().most or 0
    learned = counted.where(F.col("n") >= max(LEAST_LEARNED, LEARNED_SHARE * most)).select("wrong", "right")
    given = rare.sparkSession.createDataFrame(CONFUSIONS, "wrong string, right string")
    every = given.union(learned).distinct()
    return every.withColumn("change", anagram_hash(F.col("right")) - anagram_hash(F.col("wrong")))


def corrections(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, correct``: the best correction of each word that is misread.

    A rare word's one and two letters are joined with the confusions, at most two of which are applied to its hash; the
    changed hashes are joined with those of the frequent words."""
    latin = r"^[a-z0-9\x{df}-\x{24f}]{2,40}$"
    words = vocabulary.where(F.col("word").rlike(latin)).withColumn("hash", anagram_hash(F.col("word")))
    rare = checkpointed(words.where("digital = 0 and not word rlike '^[0-9]+$'").select("word", "hash", F.col("total").alias("own")))
    known = words.where("total >= 3 and word rlike '^[^0-9]{2,}$'")
    changes = checkpointed(confusions(rare, known))
    letters = F.expr("array_distinct(flatten(transform(array(1, 2), n -> transform(sequence(1, greatest(length(word) - n + 1, 1)), i -> substring(word, i, n)))))")
    one = rare.select("word", "hash", "own", F.explode(letters).alias("wrong")).join(changes, "wrong")
    one = one.withColumn("edits", F.greatest(F.length("wrong"), F.length("right"))).withColumn("pair", F.struct("wrong", "right"))
    also = one.select("word", F.col("pair").alias("pair_b"), F.col("change").alias("change_b"), F.col("edits").alias("edits_b"))
    two = one.join(also, "word").where("pair <= pair_b")
    asked = one.select("word", "own", (F.col("hash") + F.col("change")).alias("hash"), F.lit(1).alias("steps"), "edits").union(
        two.select("word", "own", F.col("hash") + F.col("change") + F.col("change_b"), F.lit(2), F.col("edits") + F.col("edits_b"))
    )
    known = known.select("hash", F.col("word").alias("correct"), "digital", "total")
    best = Window.partitionBy("word").orderBy("steps", F.desc("total"), "correct")
    return (
        asked.join(known, "hash")
        .where((F.col("total") >= RARER * F.col("own")) & (F.levenshtein("word", "correct", 4) >= 0))
        .where(F.levenshtein("word", "correct") <= F.col("edits"))
        .withColumn("n", F.row_number().over(best))
        .where("n = 1")
        .select("word", "correct")
    )


def broken_words(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``chunk_id, line, joined``: breaks whose mark does not belong to the word.

    The soft hyphen and the not sign never belong to a word. A hyphen belongs if the corpus has the compound's parts as
    words of their own and does not have the joined word.
    """
    breaks = found.where("kind = 'break'").select("chunk_id", "line", F.split("a", r"\|").alias("p"), F.col("b").alias("mark"))
    breaks = breaks.select("chunk_id", "line", "mark", F.element_at("p", 1).alias("left"), F.element_at("p", 2).alias("right"))
    breaks = breaks.withColumn("tail", F.element_at(F.split("left", "-"), -1)).withColumn("whole", F.concat("tail", "right"))
    # only digital counts are evidence: the scanned ones have the joined words of these very breaks
    known = vocabulary.where("digital > 0").select("word", "digital")
    for name in ("whole", "tail", "right"):
        breaks = breaks.join(known.select(F.col("word").alias(name), F.col("digital").alias(f"{name}_n")), name, "left")
    compound = F.col("whole_n").isNull() & F.col("tail_n").isNotNull() & F.col("right_n").isNotNull()
    return breaks.where(F.col("mark").isin("\xad", "¬") | ~compound).select("chunk_id", "line", F.col("whole").alias("joined"))


def noise(chunks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``chunk_id, noise``: one row for each kind of noise (hyphen, header, pageno, misread) in a chunk; ``metadata`` as in ``pages``."""
    found = notes(chunks)
    vocabulary = checkpointed(_vocabulary(found))
    head = headers(found)
    running = found.where("kind = 'word'").select("chunk_id", "line", F.col("a").alias("word")).join(head, ["chunk_id", "line"], "left_anti")
    misread = running.join(corrections(found, vocabulary).select("word"), "word", "left_semi")
    kinds = {
        "hyphen": broken_words(found, vocabulary), "header": head, "pageno": pages(found, metadata), "misread": misread,
    }
    rows = [df.select("chunk_id", F.lit(kind).alias("noise")) for kind, df in kinds.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).distinct()


def repair_text(text: str, hierarchy: list[str], drop: set[int], joins: dict[int, bool], words: dict[int, list[tuple[str, str]]]) -> str:
    """The text without the lines in ``drop``, its wrapped lines joined into paragraphs.

    ``joins`` has the lines that continue a broken word, and whether the mark before them goes; ``words`` has the
    corrections of each line, which keep the case. A text whose lines are no wrapped prose only loses dropped lines.
    """
    parsed = Lines(text, hierarchy)
    out: list[str] = []
    fresh = True
    for i, (line, role) in enumerate(zip(parsed.lines, parsed.role)):
        if i in drop:
            continue
        for wrong, right in words.get(i, []):
            line = re.sub(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", lambda m, r=right: r.capitalize() if m[0][:1].isupper() else r, line, flags=re.I)
        whole = role in ("blank", "prefix") or not parsed.wrapped or bool(_BODY.match(line))
        if whole or fresh or not out:
            out.append(line)
        elif i in joins:
            held = out[-1].rstrip()
            out[-1] = (held[:-1] if joins[i] and held[-1:] in _MARKS else held) + line.lstrip()
        else:
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
        fresh = whole
    return "\n".join(out)


def repaired(chunks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``chunk_id, text``: every chunk once, its noise repaired: headers and page numbers removed, broken words joined,
    misread words corrected, wrapped lines joined into paragraphs. A chunk's edits are one row beside its text."""
    found = notes(chunks)
    vocabulary = checkpointed(_vocabulary(found))
    head = headers(found)
    broken = broken_words(found, vocabulary).select("chunk_id", "line").distinct().withColumn("gone", F.lit("1"))
    breaks = found.where("kind = 'break'").select("chunk_id", "line").distinct().join(broken, ["chunk_id", "line"], "left")
    misread = found.where("kind = 'word'").select("chunk_id", "line", F.col("a").alias("word")).join(corrections(found, vocabulary), "word")
    none = F.lit(None).cast("string")
    edits = (
        head.union(pages(found, metadata)).select("chunk_id", "line", F.lit("drop").alias("what"), none.alias("a"), none.alias("b"))
        .union(breaks.select("chunk_id", "line", F.lit("join"), "gone", none))
        .union(misread.select("chunk_id", "line", F.lit("word"), "word", "correct"))
    )
    edits = edits.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("line", "what", "a", "b"))).alias("edits"))
    row = F.max_by(F.struct("text", "heading_hierarchy"), F.struct("text", "heading_hierarchy")).alias("row")
    once = chunks.where("text is not null").groupBy("chunk_id").agg(row).select("chunk_id", "row.*").join(edits, "chunk_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hierarchy, own in zip(*(batch.column(n).to_pylist() for n in ("text", "heading_hierarchy", "edits"))):
                drop, joins, words = set(), {}, {}
                for e in own or []:
                    if e["what"] == "drop":
                        drop.add(e["line"])
                    elif e["what"] == "join":
                        joins[e["line"]] = e["a"] is not None
                    else:
                        words.setdefault(e["line"], []).append((e["a"], e["b"]))
                texts.append(repair_text(text, hierarchy or [], drop, joins, words))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(texts, pa.string())], names=["chunk_id", "text"])

    return once.mapInArrow(work, "chunk_id string, text string")
