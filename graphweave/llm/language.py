"""Language of every document and of every paragraph in another language (problem 2).

Hyperdimensional profiles: every letter has a random vector of ones and minus ones; an n-gram is bound from its
letters' vectors, each permuted by its place; a text is the bundle, the sum, of its n-gram vectors; a language is the
bundle of its sample texts, less what all languages share, adjusted on pieces of the samples that came out wrong. Texts
and languages are compared by cosine.

The dot product of a bundle with a prototype is the sum over the text's n-grams of the n-gram vector's dot product with
the prototype, so a task works these out once for every n-gram that it meets and then sums table rows.

Null texts and texts with fewer than 40 letters have no language (null, confidence 0) and are never cases. Repeated
documents give repeated rows before the final distinct, ties between languages go to the first code in the alphabet,
empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.textnorm import LOOK_ALIKE_LETTERS
from graphweave.session import spread

DIMENSIONS, SEED = 2048, 20
#: Labelled rows that the profiles are fitted on at most: 4,000, in the order of sample_id.
MOST_SAMPLES = 4000
LEAST_LETTERS, LEAST_FOREIGN = 40, 80
#: Pieces that the prototypes are adjusted on: characters, passes, step, and the lead over the next language to reach.
PIECE, EPOCHS, RATE, MARGIN = 90, 60, 0.05, 0.15
#: Lead of a language's cosine over another's from which a paragraph clearly is in it. Names and product names inside a
#: sentence pull a paragraph towards another language by about 0.08 at most, other languages lead by about 0.15 at least.
LEAD = 0.115
_GAP = 0  # the class of everything that is no letter; runs of it count as one
# Usual spellings of languages besides code and code with region.
NAMES = {
    "de": "ger deu german deutsch allemand alemán tedesco duits niemiecki немецкий",
    "en": "eng english anglais englisch inglés inglese engels angielski английский",
    "es": "spa spanish español espanol castellano castilian spanisch espagnol",
    "fr": "fre fra french français francais französisch francés",
    "it": "ita italian italiano italienisch italien",
    "nl": "dut nld dutch nederlands flemish vlaams niederländisch hollands",
    "pl": "pol polish polski polnisch polonais język_polski",
    "pt": "por portuguese português portugues portugiesisch portugais",
    "ru": "rus russian русский russisch russe русский_язык",
}
_TABLE_OR_HEADING = re.compile(r"^[ \t]*(?:[#＃]{1,6}[ \t  -​ ]|[|｜]).*$", re.M)
_CODE_CALL = re.compile(r"^[ \t]*\w+\([^)\n]*\).*$", re.M)
_FENCE = re.compile(r"^[ \t]*(?:```|｀｀｀|~~~)", re.M)
_BLANK = re.compile(r"\n\s*\n")


def label_code(label, codes: tuple[str, ...]):
    """The code of ``codes`` that a free language label (a column) names, or null."""
    plain = F.lower(F.regexp_replace(F.trim(label), r"[\s_-]+", "_"))
    named = {n: code for code, names in NAMES.items() if code in codes for n in names.split()} or {"": None}
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    head = F.element_at(F.split(plain, "_"), 1)
    return F.when(head.isin(*codes), head).otherwise(F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, head)))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The letter class of each code point: look-alikes, full widths and cases share one; 255 marks invisible ones."""
    table = np.zeros(0x110000, np.uint8)
    folded: dict[str, int] = {}
    for code in [*range(0x41, 0x250), *range(0x400, 0x460), *range(0xFF21, 0xFF5B)]:
        ch = unicodedata.normalize("NFKC", chr(code)).lower()
        if len(ch) == 1 and ch.isalpha() and (ord(ch) < 0x180 or 0x400 <= ord(ch) < 0x460):
            table[code] = folded.setdefault(ch, len(folded) + 1)
    for pair in LOOK_ALIKE_LETTERS.split():
        if pair[1].lower() in folded:
            table[ord(pair[0])] = folded[pair[1].lower()]
    table[[0xAD, 0xFEFF, 0x2060, *range(0x200B, 0x2010)]] = 255
    return table


SYMBOLS = 256


class Profiles:
    """Random letter vectors, language prototypes and the table of n-gram scores met so far."""

    def __init__(self, prototypes: np.ndarray | None = None, codes: tuple[str, ...] = ()) -> None:
        self.codes = codes
        draw = np.random.default_rng(SEED)
        self.letters = draw.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        self.prototypes = prototypes
        self.place: np.ndarray | None = None
        self.scores = np.zeros((0, len(codes)), np.float32)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams given as numbers: first letter permuted twice, second once."""
        a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
        return np.roll(self.letters, 2, 1)[a] * np.roll(self.letters, 1, 1)[b] * self.letters[c]

    @staticmethod
    def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of all texts, the text of each, and the number of letters of each text."""
        joined = unicodedata.normalize("NFC", "\n\n".join(texts) + "\n\n") if texts else ""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = [len(t) for t in texts]
        if len(joined) != sum(ends) + 2 * len(ends):
            ends = [len(unicodedata.normalize("NFC", t)) for t in texts]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.array(ends, np.int64) + 2)[: len(code)]
        letter = _classes()[code]
        keep = letter != 255
        letter, owner = letter[keep], owner[keep]
        keep = np.ones(len(letter), bool)
        keep[1:] = (letter[1:] != _GAP) | (letter[:-1] != _GAP)
        letter, owner = letter[keep].astype(np.int32), owner[keep]
        sizes = np.bincount(owner[letter != _GAP], minlength=len(texts))
        if len(letter) < 3:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), sizes
        return letter[:-2] * SYMBOLS**2 + letter[1:-1] * SYMBOLS + letter[2:], owner[1:-1], sizes

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The vector of a text; a repeated n-gram weighs by the logarithm of its count."""
        found, counts = np.unique(grams, return_counts=True)
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(found), 4096):
            total += np.log1p(counts[at : at + 4096]) @ self.bind(found[at : at + 4096])
        return total / max(1e-9, np.linalg.norm(total))

    def fit(self, texts: list[str], labels: list[str]) -> Profiles:
        """Bundles the sample texts of each language, takes off the part that all languages share, then moves the
        prototypes towards the pieces of samples that they miss and away from those they wrongly attract. The languages are
        those of the samples."""
        self.codes = tuple(sorted(set(labels)))
        self.scores = np.zeros((0, len(self.codes)), np.float32)
        bundles = np.array([self.bundle(self.grams([t for t, x in zip(texts, labels) if x == c])[0]) for c in self.codes]).reshape(-1, DIMENSIONS)
        if len(self.codes) > 1:
            bundles -= bundles.mean(0)
        pieces = [(t[at : at + PIECE], self.codes.index(x)) for t, x in zip(texts, labels) for at in range(0, len(t), PIECE // 2)]
        pieces = [(t, k) for t, k in pieces if len(t) >= PIECE // 2]
        vectors = np.array([self.bundle(self.grams([t])[0]) for t, _ in pieces]).reshape(-1, DIMENSIONS)
        truth = np.array([k for _, k in pieces], int)
        for _ in range(EPOCHS if len(pieces) and len(self.codes) > 1 else 0):
            unit = bundles / np.maximum(1e-9, np.linalg.norm(bundles, axis=1, keepdims=True))
            close = vectors @ unit.T
            own = close[np.arange(len(truth)), truth]
            close[np.arange(len(truth)), truth] = -np.inf
            rival = close.argmax(1)
            missed = np.flatnonzero(own < close.max(1) + MARGIN)
            if not len(missed):
                break
            np.add.at(bundles, truth[missed], RATE * vectors[missed])
            np.add.at(bundles, rival[missed], -RATE * vectors[missed])
        self.prototypes = (bundles / np.maximum(1e-9, np.linalg.norm(bundles, axis=1, keepdims=True))).astype(np.float32)
        return self

    def _score(self, grams: np.ndarray) -> np.ndarray:
        """Each n-gram's dot products with the prototypes; new n-grams are bound once."""
        if self.place is None:
            self.place = np.full(SYMBOLS**3, -1, np.int32)
        new = np.zeros(SYMBOLS**3, bool)
        new[grams] = True
        new = np.flatnonzero(new & (self.place < 0))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.place[some] = len(self.scores) + np.arange(len(some))
            self.scores = np.concatenate([self.scores, self.bind(some).astype(np.float32) @ self.prototypes.T])
        return self.scores[self.place[grams]]

    def compare(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's cosines with the languages, its number of letters and its vector's length.

        n-gram vectors are all but orthogonal, so a bundle's squared length is ``DIMENSIONS`` times the sum of the
        squared counts.
        """
        total = np.zeros((len(texts), len(self.codes)), np.float32)
        grams, owner, sizes = self.grams(texts)
        for at in range(0, len(grams), 1_000_000):
            part, who = grams[at : at + 1_000_000], owner[at : at + 1_000_000]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            total[who[first]] += np.add.reduceat(self._score(part), first, 0)
        ordered = np.sort(owner.astype(np.int64) * SYMBOLS**3 + grams)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)
        counts = np.diff(np.r_[first, len(ordered)]).astype(float)
        squared = np.bincount(ordered[first] // SYMBOLS**3, counts**2, len(texts)) if len(first) else np.zeros(len(texts))
        length = np.sqrt(np.maximum(1, squared) * DIMENSIONS)
        return total / length[:, None], sizes, length


def paragraphs(text: str) -> list[str]:
    """The prose of each paragraph of ``text``; headings, table rows and code are left out of it."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, fenced = [], False
    for piece in _BLANK.split(text):
        if not piece.strip():
            continue
        inside = fenced
        if "`" in piece or "｀" in piece or "~~~" in piece:
            marks = len(_FENCE.findall(piece))
            fenced ^= marks % 2 == 1
            inside = inside or marks > 0
        if inside:
            out.append("")
            continue
        if "#" in piece or "|" in piece or "＃" in piece or "｜" in piece:
            piece = _TABLE_OR_HEADING.sub("", piece)
        if "(" in piece:
            piece = _CODE_CALL.sub("", piece)
        out.append(piece)
    return out


def fit_profiles(samples: DataFrame) -> Profiles:
    """Profiles fitted on at most ``MOST_SAMPLES`` labelled rows; the bound is the size of what comes to the driver. Without
    samples there are no languages, and no text has one."""
    rows = samples.where("text is not null and lang is not null").orderBy("sample_id").limit(MOST_SAMPLES).select("lang", "text").collect()
    return Profiles().fit([r.text for r in rows], [r.lang for r in rows])


def document_languages(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, file_hash, seg_no, lang, confidence, letters``: the main language (seg_no -1) of every document, then
    each paragraph of at least 80 letters of prose in another language, with its number.

    ``confidence`` is a soft maximum of the cosines.
    """
    prototypes, codes = profiles.prototypes, profiles.codes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(prototypes, codes)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield _label(batch.slice(at, 2000), own)

    schema = "doc_id bigint, file_hash string, seg_no int, lang string, confidence double, letters bigint"
    rows = documents.select("doc_id", "file_hash", "text")
    return spread(rows if codes else rows.withColumn("text", F.lit(None).cast("string"))).mapInArrow(work, schema)


def _label(batch: pa.RecordBatch, profiles: Profiles) -> pa.RecordBatch:
    texts, codes = batch.column("text").to_pylist(), profiles.codes or ("",)
    parts = [paragraphs(t) if t is not None else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    number = np.concatenate([np.arange(len(p)) for p in parts] or [np.zeros(0, int)]).astype(int)
    cosine, letters, length = profiles.compare([x for p in parts for x in p])
    cosine = cosine if cosine.shape[1] else np.zeros((len(cosine), 1))
    best, rank = cosine.argmax(1), np.sort(cosine, 1)
    # the main language: most letters among paragraphs that are long and clear, else the bundle of all
    second = rank[:, -2] if len(codes) > 1 else -1.0
    clear = (letters >= LEAST_LETTERS) & (rank[:, -1] - second >= LEAD)
    weight = np.zeros((len(texts), len(codes)))
    np.add.at(weight, (owner[clear], best[clear]), letters[clear])
    summed = np.zeros((len(texts), len(codes)))
    np.add.at(summed, owner, cosine * length[:, None])
    span = np.sqrt(np.bincount(owner, length**2, len(texts)))
    mean = summed / np.maximum(1, span)[:, None]
    main = np.where(weight.any(1), weight.argmax(1), mean.argmax(1))
    prose = np.bincount(owner, letters, len(texts)).astype(np.int64)
    bare = [i for i, t in enumerate(texts) if t is not None and prose[i] < LEAST_LETTERS]
    if bare and profiles.codes:  # hardly any prose: the whole text decides
        mean[bare], prose[bare], _ = profiles.compare([texts[i] for i in bare])
        main[bare] = mean[bare].argmax(1)
    told = (prose >= LEAST_LETTERS) & bool(profiles.codes)
    lead = cosine.max(1, initial=0) - cosine[np.arange(len(best)), main[owner]]
    foreign = (letters >= LEAST_FOREIGN) & (lead >= LEAD) & told[owner]
    docs = np.r_[np.arange(len(texts)), owner[foreign]]
    seg = np.r_[np.full(len(texts), -1), number[foreign]].astype(np.int32)
    lang = np.r_[main, best[foreign]]
    size = np.r_[prose, letters[foreign]].astype(np.int64)
    known = np.r_[told, np.ones(foreign.sum(), bool)]
    mean = np.r_[mean, cosine[foreign]]
    odds = np.exp(40 * (mean - mean.max(1, keepdims=True)))
    sure_of = np.where(known, (odds / odds.sum(1, keepdims=True))[np.arange(len(docs)), lang], 0.0)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(docs)), batch.column("file_hash").take(pa.array(docs)), pa.array(seg),
            pa.array(np.array(codes, object)[lang], pa.string(), mask=~known), pa.array(sure_of), pa.array(size),
        ],
        names=["doc_id", "file_hash", "seg_no", "lang", "confidence", "letters"],
    )


def current_labels(metadata: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """``file_hash, label``: the language code that the current row of each file names, or null."""
    newest = metadata.groupBy("file_hash").agg(F.max_by(F.struct("language"), "ingested_at").alias("row"))
    return newest.select("file_hash", label_code(F.col("row.language"), codes).alias("label"))


def wrong_languages(documents: DataFrame, metadata: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, seg_no, lang``: the documents whose current label does not name their main language or that have a
    paragraph in another language, each with its main language (seg_no -1) and all such paragraphs.

    Texts never leave their task: only the few columns of the result are joined with the labels.
    """
    profiles = fit_profiles(samples)
    found = document_languages(documents, profiles).where("lang is not null")
    rows = found.groupBy("doc_id", "file_hash").agg(
        F.min(F.when(F.col("seg_no") == -1, F.col("lang"))).alias("main"),
        F.collect_set(F.struct("seg_no", "lang")).alias("rows"),
    )
    cases = rows.join(current_labels(metadata, profiles.codes), "file_hash", "left").where(
        (F.size("rows") > 1) | F.col("label").isNull() | (F.col("label") != F.col("main"))
    )
    return cases.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.seg_no", "r.lang").distinct()
