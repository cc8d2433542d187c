"""Variant spellings of the names of persons and organisations (problem 1).

Every distinct spelling is read once into a whole normal name: nicknames and abbreviations are spelled out, titles, legal
forms, middle initials and the order of parts do not count. A name is a vector of weighted character n-grams, each bound to
the first letter of another word of the name. A distributed sparse join finds all pairs of names whose cosine reaches
``LEAST_COSINE``; an exact check of the parts follows; average linkage groups the pairs that are left. A name with only an
initial, an ambiguous nickname or no line of business joins the one group that it can mean by the same join; where it can
mean several, a full alias of its row decides, else it stays alone.

Null and blank names, and strings that name neither a person nor an organisation, are in no result. Repeated rows count
once, empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.operators import resolve as core_resolve
from graphweave.session import checkpointed

#: Length of the n-grams, the least cosine of a pair, and the least average cosine at which two clusters are joined.
GRAM, LEAST_COSINE, LINKAGE = 3, 0.55, 0.4
#: An n-gram that one name in so many has weighs 0.7, rarer ones up to 1, more frequent ones less; shares are of a table of
#: at least so many names, since a few names say little about what is frequent.
HALF_WEIGHT, LEAST_TOTAL = 200, 10_000
#: Rows of a posting list or a cluster that meet in one group; longer ones are split on one side and repeated on the other.
MOST_TOGETHER = 2_000
#: Names of a connected component that one task groups at once; larger ones go through distributed rounds first.
MOST_IN_TASK = 1_000
# Strings in place of a name that is not known.
NO_NAMES = frozenset("n/a na none null nil unknown tbd".split())
# Spellings of the two types.
PERSON_TYPES = ("PERSON", "PEOPLE", "PERSONS", "HUMAN")
ORGANISATION_TYPES = ("ORGANIZATION", "ORGANISATION", "ORG", "COMPANY", "ORGANIZATIONS")
# Titles and legal forms, which are no part of a name.
TITLES = frozenset("dr prof mr mrs ms miss sir dame ing eng dipl rev hon capt phd md msc jr sr".split())
LEGAL = frozenset("inc incorporated ltd limited co company corp corporation llc plc gmbh ag sa nv bv the".split())
# Words for lines of business.
BUSINESS = (
    "academy agency analytics archives association authority bank bureau chemicals college committee consulting council "
    "department division energy engineering enterprises farms foods foundation freight group holding industries institute "
    "instruments laboratories logistics manufacturing ministry museum networks office partners pharmaceuticals press "
    "publishing registry research school services society software solutions storage studios syndicate systems "
    "technologies trading transport trust university utilities ventures water works"
).split()
ABBREVIATED_BUSINESS = {
    "labs": "laboratories", "lab": "laboratories", "svcs": "services", "svc": "services", "mfg": "manufacturing",
    "inst": "institute", "res": "research", "publ": "publishing", "tech": "technologies", "engr": "engineering",
    "mgmt": "management", "univ": "university", "ind": "industries", "laboratory": "laboratories",
}
#: General words that say nothing more beside another line of business.
GENERAL_BUSINESS = frozenset("services networks institute storage group holding systems solutions works".split())
# Given names, each with its usual short forms.
GIVEN = """alexander alex sandy alec; alexandra sandra lexi; andrea andi; andreas; andrew andy drew; anthony tony ant; arthur art;
barbara barb babs barbie; benjamin ben benny benji; carl; carla; carol; carola; caroline carrie; catherine cathy; charles charlie chuck; charlotte
lottie charlie char; christina tina chrissy; christopher chris kit topher; daniel dan danny; daniela dani; david dave davy;
deborah deb debbie; dominic dom nic; donald don; dorothy dot dottie dolly dory; edward ed eddie ted ned; eleanor ellie nell nora;
elizabeth liz beth lizzie eliza betty; ferdinand ferdy; frances fran; francis frank; frederick fred freddy freddie; gabriela gabi
gabby gaby; george georgie; gerald gerry; gregory greg; helena helen lena nell; henrietta hettie etta hetty; henry harry hal; hubert
bert; ignatius iggy; isabella bella izzy isa; jacob jake; james jim jimmy jamie; jennifer jen jenny; john jack johnny;
jonathan jon jonty jonny johnny; joseph joe joey; josephine jo josie fina; julian jules; juliana julie jules; katherine kate kathy katie
kat kay; kenneth ken kenny; lawrence larry laurie; leonard len lenny; leonardo leo; louise lou; magdalena lena maggie; margaret
peggy maggie meg marge greta; martin marty; martina tina; matthew matt; maximilian max; michael mike mick mickey; michelle;
nathaniel nate nat; nicholas nick nico nicky; olivia liv livvy olive; pamela pam; patricia pat patty trish tricia; patrick paddy; peter
pete; philip phil; quentin quen quint quinn; rebecca becky becca; richard rick dick rich; robert bob rob bobby robbie; roberta;
ronald ron; samantha sam sammy; samuel sam sammy; sebastian seb; simon si; simone; sophia sophie; stephen steve; stephanie steph;
susan sue susie; theodora dora; theodore theo ted teddy; thomas tom tommy; timothy tim timmy; ursula ursel uschi ursa; valentina val;
victor vic; victoria vicky tori vicki; vincent vince vinny; virginia ginny; walter walt; wilhelmina mina willa minnie billie wilma;
william will bill billy liam; xaviera xavi; xavier; yolanda yoli yola; yvonne; zachary zack zach zac"""


@lru_cache(maxsize=1)
def _given() -> tuple[dict[str, frozenset[str]], tuple[str, ...]]:
    """What full names each given name or short form can stand for, and all full names."""
    means: dict[str, set[str]] = {}
    entries = [x.split() for x in GIVEN.replace("\n", " ").split(";")]
    full = [x[0] for x in entries]
    for name, *short in entries:
        for s in short:
            if s not in full:
                means.setdefault(s, set()).add(name)
    for name in full:
        means[name] = {name}
    return {k: frozenset(v) for k, v in means.items()}, tuple(full)


def _edits(a: str, b: str, most: int) -> int:
    """The number of inserted, dropped, replaced or swapped letters between two words, or ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=200_000)
def _close(word: str, among: tuple[str, ...]) -> tuple[str, ...]:
    """The words of a list that are a typing error away."""
    if len(word) < 4:
        return ()
    return tuple(x for x in among if (x[0] == word[0] or x[-1] == word[-1]) and _edits(word, x, 1) <= 1)


def _shortens(token: str, word: str) -> bool:
    """Whether the token has the word's first letter and then some of its letters in their order."""
    rest = iter(word[1:])
    return token[0] == word[0] and len(token) < len(word) and all(c in rest for c in token[1:])


@lru_cache(maxsize=1)
def _business_words() -> tuple[str, ...]:
    return tuple(BUSINESS)


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().strip()


def _business(token: str, dotted: bool) -> str | None:
    """The word for a line of business that a token spells, abbreviates or misspells."""
    if token in BUSINESS:
        return token
    if token in ABBREVIATED_BUSINESS:
        return ABBREVIATED_BUSINESS[token]
    if dotted and len(token) >= 3:
        starts = [b for b in BUSINESS if b.startswith(token)] or [b for b in BUSINESS if _shortens(token, b)]
        return starts[0] if starts else None
    return next(iter(_close(token, _business_words())), None)


def parse(raw: str, hint: str = "") -> tuple[str, str, str] | None:
    """``kind, block, core`` of a name. ``kind`` is P or O. ``block`` is a person's given name or an organisation's line of
    business. Blocks that leave open what they mean hold a mark: the start of a given name and a star, alternatives between
    bars, a star alone for no line of business, and a question mark behind the given name of what may be no person at all.
    A person of one name has the block ``-``."""
    text = re.sub(r"\([^)]*\)", " ", _plain(raw))
    parts = [(t, d == ".") for t, d in re.findall(r"([^\W_]+)(?:['’]s\b)?(\.?)", text)]
    comma = [len(re.findall(r"[^\W_]+", x)) for x in text.split(",")]
    if not parts or text.strip() in NO_NAMES:
        return None
    words = [(t, d) for t, d in parts if t not in LEGAL]
    legal = len(words) < len([t for t, _ in parts if t != "the"])
    known, full = _given()
    begun = parts[0][1] and any(x.startswith(parts[0][0]) for x in full)  # "Marg. Surname"
    given = (begun or any(t in known for t, _ in parts)) and not legal and not any(t in BUSINESS for t, _ in parts)
    if hint != "P" and not (given and hint == ""):
        found = _organisation(words, legal or hint == "O")
        if found:
            return found
    return _person(parts, comma, hint == "P") if hint != "O" else None


def _organisation(words: list[tuple[str, bool]], certain: bool) -> tuple[str, str, str] | None:
    kinds, own = [], []
    for token, dotted in words:
        kind = _business(token, dotted)
        if kind:
            kinds.append(kind)
        elif token not in ("and", "of", "for"):
            own.append(token)
    if len(own) == 1 and not kinds:
        glued = next((b for b in BUSINESS if own[0].endswith(b) and len(own[0]) > len(b) + 3), None)
        if glued:
            kinds, own = [glued], [own[0].removesuffix(glued)]
    core = "".join(own)
    if not core or not (kinds or certain) or (not certain and len(core) < 3):
        return None
    special = set(kinds) - GENERAL_BUSINESS or set(kinds)
    return "O", " ".join(sorted(special)) or "*", core


def guess(raw: str) -> tuple[str, str, str] | None:
    """Two or three words that no list knows: a person, if some row has that person's name."""
    text = _plain(raw)
    words = [t for t in re.findall(r"[^\W_]+", text) if t not in TITLES and len(t) > 1]
    if not 2 <= len(words) <= 3:
        return None
    if text.count(",") == 1 and len(re.findall(r"[^\W_]+", text.split(",")[1])) == 1:
        words = words[-1:] + words[:-1]
    return "P", words[0] + "?", "".join(words[1:])


def _person(parts: list[tuple[str, bool]], comma: list[int], sure: bool) -> tuple[str, str, str] | None:
    means, full = _given()
    tokens = [(t, d) for t, d in parts if t not in TITLES]
    if len(tokens) < 2:
        return ("P", "-", tokens[0][0]) if sure and tokens and len(tokens[0][0]) > 1 else None
    order = list(range(len(tokens)))
    if len(comma) == 2 and comma[0] and comma[1]:  # "Surname, Given": what stands behind the comma is looked at first
        behind = min(comma[1], len(tokens) - 1)
        order = order[-behind:] + order[:-behind]
    chosen, block = None, ""
    for exact in (True, False):
        for i in order:
            token, _ = tokens[i]
            meant = means.get(token, ()) if exact else _close(token, full) if len(token) > 4 else ()
            if meant:
                chosen, block = i, "|".join(sorted(meant))
                break
        if chosen is not None:
            break
    if chosen is None:
        for i in order:
            token, dotted = tokens[i]
            if len(token) == 1 or (dotted and len(token) <= 5):
                chosen, block = i, token + "*"
                break
    if chosen is None and sure:  # an unknown given name: the first part, or the one behind the comma
        chosen, block = order[0], tokens[order[0]][0]
    if chosen is None:
        return None
    core = "".join(t for k, (t, _) in enumerate(tokens) if k != chosen and len(t) > 1)
    if not core and sure and "*" not in block:  # "Prof. Ann": one name
        return "P", "-", tokens[chosen][0]
    return ("P", block, core) if len(core) >= (2 if sure else 4) else None


def grams(kind: str, block: str, core: str) -> list[str]:
    """The n-grams of a whole normal name, each bound to the first letter of another word; a name of one word binds to none."""
    found = set()
    for meaning in block.split("|"):
        words = [w for w in [*re.sub(r"[*?-]", "", meaning).split(), core] if w]
        for i, word in enumerate(words):
            spans = [f"^{word}"] if len(word) == 1 else [f"^{word}$"[k : k + GRAM] for k in range(len(word) + 3 - GRAM)]
            for letter in {w[0] for j, w in enumerate(words) if j != i} or {""}:
                found.update(f"{kind}{letter} {x}" for x in spans)
    return sorted(found)


def spellings(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of raw names with a hint of their kind: rows' names, rows' aliases, and endpoints that are no row's name."""
    kind = F.upper(F.trim("type"))
    hint = F.when(kind.isin(*PERSON_TYPES), "P").when(kind.isin(*ORGANISATION_TYPES), "O").when(kind.isNull() | (kind == ""), "")
    rows = entities.select("entity_id", "name", "aliases", hint.alias("hint")).where("hint is not null")
    names = rows.select("entity_id", F.col("name").alias("raw"), "hint").where("trim(raw) != ''").distinct()
    aliases = rows.select("entity_id", F.explode("aliases").alias("raw"), "hint").where("trim(raw) != ''").distinct()
    sides = [
        relationships.select(F.lit(side).alias("kind"), "rel_id", F.col(f"{side}_entity").alias("raw")) for side in ("source", "target")
    ]
    known = entities.select(F.col("name").alias("raw")).where("raw is not null").distinct()
    # distinct first: one endpoint holds a large share of the rows
    ends = sides[0].union(sides[1]).where("trim(raw) != ''").distinct()
    unknown = ends.select("raw").distinct().join(known, "raw", "left_anti")
    return names, aliases, ends.join(unknown, "raw").withColumn("hint", F.lit(""))


def forms(raws: DataFrame) -> DataFrame:
    """``raw, hint, kind, block, core, form`` of the distinct raw names that name a person or an organisation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, hint in zip(batch.column("raw").to_pylist(), batch.column("hint").to_pylist()):
                found = parse(raw, hint) or (guess(raw) if hint == "" else None)
                if found:
                    rows.append((raw, hint, *found, "/".join(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 6)], names=names)

    names = ["raw", "hint", "kind", "block", "core", "form"]
    return raws.select("raw", "hint").distinct().mapInArrow(work, ", ".join(f"{n} string" for n in names))


def vectors(found: DataFrame) -> DataFrame:
    """``form, kind, block, core, listed, gram, weight, df, norm``: a row for each n-gram of each distinct form. ``weight`` falls
    with the number of forms that have the n-gram (``df``), ``norm`` is the length of the form's vector."""
    schema = "form string, kind string, block string, core string, listed boolean, grams array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _given()[1]
        for batch in batches:
            rows = [batch.column(n).to_pylist() for n in ("kind", "block", "core")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in ("form", "kind", "block", "core")], pa.array([b in listed for b in rows[1]], pa.bool_()),
                    pa.array([grams(*x) for x in zip(*rows)], pa.list_(pa.string())),
                ],
                names=["form", "kind", "block", "core", "listed", "grams"],
            )

    named = found.select("form", "kind", "block", "core").distinct().mapInArrow(work, schema)
    rows = named.select("form", "kind", "block", "core", "listed", F.explode("grams").alias("gram")).withColumn("gram", F.xxhash64("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("df"))
    total = found.select("form").distinct().count()
    rows = rows.join(often, "gram").withColumn("weight", 1 / F.sqrt(1 + F.col("df") * HALF_WEIGHT / F.lit(max(LEAST_TOTAL, total))))
    return rows.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("form"))))


def prefixes(rows: DataFrame) -> DataFrame:
    """The n-grams of each form, rarest first, without the tail that is too short a vector for ``LEAST_COSINE``: two forms of
    that cosine share an n-gram of both prefixes, since all that they share is no longer than either tail otherwise."""
    rarest = Window.partitionBy("form").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(rarest), F.lit(0.0))
    whole = F.col("norm") * F.col("norm")
    # the slack keeps pairs that are at the threshold up to rounding
    return rows.where(F.col("norm") > 0).withColumn("rest", whole - before).where(F.col("rest") >= (LEAST_COSINE**2 - 1e-9) * whole).drop("rest")


def _near(a: Column, b: Column) -> Column:
    """Few enough edits for two spellings of one name; a swap of letters counts two, and may go with a third edit.

    Most pairs are further apart than their length allows, which takes one bounded distance to see."""
    short = F.least(F.length(a), F.length(b))
    most = F.when(short >= 11, 3).when(short >= 7, 2).when(short >= 4, 1).otherwise(0)
    letters = F.levenshtein(*(F.array_join(F.array_sort(F.split(x, "")), "") for x in (a, b)))
    within = F.call_function("levenshtein", a, b, most) >= 0
    # conditions, not conjunctions: Spark works out what conjunctions share for every row
    return F.when(within, F.when(short < 11, True).when(F.levenshtein(a, b, 2) >= 0, True).otherwise(letters <= 2)).otherwise(False)


def _postings(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("form", "block", "core", "listed")], *([] if x == "a" else ["df"]))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings joined by n-gram; those of a long list meet in parts, of which each left row is in one."""
    parts = F.ceil(F.col("df") / MOST_TOGETHER)
    right = _postings(right, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("df")
    left = left.withColumn("part", F.pmod(F.xxhash64("form"), parts))
    left = left.select("gram", "part", *[F.col(c).alias(f"{c}_a") for c in ("form", "block", "core", "listed")])
    return left.join(right, ["gram", "part"])


def _cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (``form_a, form_b``) with their ``cosine``, those below ``LEAST_COSINE`` left out."""
    whole = rows.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("v"), F.first("norm").alias("norm"))
    for x in "ab":
        pairs = pairs.join(whole.select(F.col("form").alias(f"form_{x}"), F.col("v").alias(f"v_{x}"), F.col("norm").alias(f"norm_{x}")), f"form_{x}")
    product = F.expr("aggregate(map_entries(v_a), 0D, (s, e) -> s + e.value * coalesce(try_element_at(v_b, e.key), 0D))")
    pairs = pairs.withColumn("cosine", product / F.col("norm_a") / F.col("norm_b")).drop("v_a", "v_b", "norm_a", "norm_b")
    return pairs.where(F.col("cosine") >= LEAST_COSINE - 1e-9)


def is_open(block: Column) -> Column:
    """Whether a block leaves open what it means."""
    return block.rlike(r"[*|?]")


def similar_forms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``form_a, form_b, cosine`` of forms of one block, and pairs ``open, full, edits`` of a form that leaves its block
    open with the full forms that it can mean. Both are all pairs of at least ``LEAST_COSINE`` whose parts agree.

    Spark evaluates the check of the parts first, inside the join of the prefixes, since pairs are fewer after it; what
    is left is the same in either order.
    """
    rows = checkpointed(vectors(found))
    rare = checkpointed(prefixes(rows))
    near = _near(F.col("core_a"), F.col("core_b"))
    # a given name that is in no list may be misspelt, and its place is a guess
    unlisted = F.col("form_a").startswith("P") & ~(F.col("listed_a") & F.col("listed_b")) & ~is_open(F.col("block_a")) & ~is_open(F.col("block_b"))
    turned = F.when(_near(F.col("block_a"), F.col("core_b")), _near(F.col("core_a"), F.col("block_b"))).otherwise(False)
    one_block = F.when(F.col("block_a") == F.col("block_b"), True).when(unlisted, _near(F.col("block_a"), F.col("block_b"))).otherwise(False)
    agree = F.when(one_block, near).otherwise(False) | F.when(unlisted, turned).otherwise(False)
    pairs = _met(rare, rare).where((F.col("form_a") < F.col("form_b")) & agree).select("form_a", "form_b").distinct()
    pairs = _cosines(pairs, rows)
    open_rows = rare.where(is_open(F.col("block")))
    full_rows = rare.where(~is_open(F.col("block")))
    bare = F.regexp_replace("block_a", r"[*?]", "")
    could = F.when(F.col("block_a").contains("|"), F.array_contains(F.split("block_a", r"\|"), F.col("block_b")))
    could = could.when(F.col("block_a").contains("*"), F.startswith("block_b", bare)).otherwise(_near(bare, F.col("block_b")))
    turned = F.when(_near(bare, F.col("core_b")), _near(F.col("core_a"), F.col("block_b"))).otherwise(False)
    meant = F.when(could, near).otherwise(False) | F.when(F.col("block_a").contains("?"), turned).otherwise(False)
    meant = _met(open_rows.where("kind = 'P'"), full_rows.where("kind = 'P'")).where(meant)
    meant = _cosines(meant.select("form_a", "form_b", F.levenshtein("core_a", "core_b").alias("edits")).distinct(), rows)
    meant = meant.select(F.col("form_a").alias("open"), F.col("form_b").alias("full"), "edits")
    return pairs, meant.union(_without_business(found))


def _without_business(found: DataFrame) -> DataFrame:
    """``open, full, edits`` for organisations without a line of business: compared with the others without theirs."""
    named = found.where("kind = 'O'").select("form", "block", "core").distinct()
    bare = named.select(F.concat(F.lit("O/*/"), "core").alias("form"), F.lit("O").alias("kind"), F.lit("*").alias("block"), "core").distinct()
    rows = checkpointed(vectors(bare))
    rare = prefixes(rows)
    asked = rare.join(named.where("block = '*'").select("form"), "form", "left_semi")
    met = _met(asked, rare).where(_near(F.col("core_a"), F.col("core_b")))
    met = _cosines(met.select("form_a", "form_b", "core_b", F.levenshtein("core_a", "core_b").alias("edits")).distinct(), rows)
    full = named.where("block != '*'").select(F.col("form").alias("full"), F.col("core").alias("core_b"))
    return met.join(full, "core_b").select(F.col("form_a").alias("open"), "full", "edits")


def components(pairs: DataFrame) -> DataFrame:
    """``form, component`` of all forms in a pair: the smallest form that a chain of pairs leads to."""
    found = core_resolve.components(pairs.select(F.col("form_a").alias("a"), F.col("form_b").alias("b")))
    return found.select(F.col("key").alias("form"), "component")


def average_linkage(mentions: dict[str, int], pairs: dict[tuple[str, str], float]) -> dict[str, str]:
    """The cluster of each name, called by its smallest member, given how often each name is mentioned.

    The two clusters of highest average cosine between their mentions are joined as long as that is at least ``LINKAGE``;
    pairs that are not given count as 0. Ties go to the smaller names."""
    names = sorted(mentions)
    if len(pairs) <= 1:
        first = names[:1] if all(c >= LINKAGE for c in pairs.values()) else None
        return {n: first[0] if first else n for n in names}
    place = {n: i for i, n in enumerate(names)}
    size, parent = np.array([float(mentions[n]) for n in names]), np.arange(len(names))
    total = np.zeros((len(names), len(names)))
    for (a, b), cosine in pairs.items():
        i, j = place[a], place[b]
        total[i, j] = total[j, i] = cosine * size[i] * size[j]
    mean = total / np.outer(size, size)
    while len(names) > 1:
        i, j = divmod(int(mean.argmax()), len(names))
        if mean[i, j] < LINKAGE:
            break
        total[i] += total[j]
        total[:, i] = total[i]
        total[i, i] = 0
        total[j] = total[:, j] = 0
        size[i] += size[j]
        mean[i] = mean[:, i] = total[i] / (size[i] * size)
        mean[j] = mean[:, j] = 0
        parent[parent == j] = i
    return {n: names[min(np.flatnonzero(parent == parent[place[n]]))] for n in names}


def _mutual(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``form, into``: every two clusters that are each other's closest, to be joined in one round over all clusters.

    Average linkage never makes two clusters closer than their parts were, so this gives the same groups as joining the
    closest pair of all again and again. ``pairs`` has ``form_a < form_b, total`` (the sum of cosines over mentions),
    ``sizes`` has ``form, mentions``."""
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("form").alias(f"form_{x}"), F.col("mentions").alias(f"n_{x}")), f"form_{x}")
    mean = pairs.withColumn("mean", F.col("total") / F.col("n_a") / F.col("n_b")).where(F.col("mean") >= LINKAGE)
    both = mean.select("form_a", "form_b", "mean").union(mean.select("form_b", "form_a", "mean"))
    # the order of equal means is one for the whole table, so that some pair is always mutual
    rank = F.struct(-F.col("mean"), F.least("form_a", "form_b"), F.greatest("form_a", "form_b"))
    best = both.groupBy("form_a").agg(F.min_by("form_b", rank).alias("form_b"))
    back = best.select(F.col("form_b").alias("form_a"), F.col("form_a").alias("form_b"))
    mutual = best.join(back, ["form_a", "form_b"]).where("form_a < form_b")
    return mutual.select(F.col("form_b").alias("form"), F.col("form_a").alias("into"))


def _joined(pairs: DataFrame, sizes: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    for x in "ab":
        moved = merged.select(F.col("form").alias(f"form_{x}"), F.col("into").alias(f"into_{x}"))
        pairs = pairs.join(moved, f"form_{x}", "left").withColumn(f"form_{x}", F.coalesce(f"into_{x}", f"form_{x}")).drop(f"into_{x}")
    pairs = pairs.where("form_a != form_b").groupBy(F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b"))
    pairs = pairs.agg(F.sum("total").alias("total"))
    sizes = sizes.join(merged, "form", "left").groupBy(F.coalesce("into", "form").alias("form")).agg(F.sum("mentions").alias("mentions"))
    return pairs, sizes


def linkage_rounds(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``form, cluster`` of the forms of ``pairs`` by average linkage in distributed rounds, however large a component is."""
    sizes = mentions.join(pairs.select(F.col("form_a").alias("form")).union(pairs.select("form_b")).distinct(), "form")
    of = checkpointed(sizes.select("form", F.col("form").alias("cluster")))
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("form").alias(f"form_{x}"), F.col("mentions").alias(f"n_{x}")), f"form_{x}")
    pairs = checkpointed(pairs.select("form_a", "form_b", (F.col("cosine") * F.col("n_a") * F.col("n_b")).alias("total")))
    sizes = checkpointed(sizes)
    while True:
        merged = checkpointed(_mutual(pairs, sizes))
        if merged.isEmpty():
            return of
        pairs, sizes = (checkpointed(x) for x in _joined(pairs, sizes, merged))
        moved = merged.withColumnRenamed("form", "cluster")
        of = checkpointed(of.join(moved, "cluster", "left").select("form", F.coalesce("into", "cluster").alias("cluster")))


def clusters(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``form, cluster`` of all forms in a pair, by average linkage of their mentions within each connected component.

    Components of at most ``MOST_IN_TASK`` forms are grouped each in one task, larger ones in distributed rounds over
    all of them; both give the same groups.
    """
    pairs = checkpointed(pairs.select("form_a", "form_b", "cosine"))
    of = components(pairs)
    size = of.groupBy("component").agg(F.count("*").alias("forms"))
    large = checkpointed(size.where(F.col("forms") > MOST_IN_TASK).select("component"))
    grouped = pairs.join(of.withColumnRenamed("form", "form_a"), "form_a")
    several = not large.isEmpty()
    far = linkage_rounds(grouped.join(large, "component", "left_semi").select("form_a", "form_b", "cosine"), mentions) if several else None
    if several:
        grouped = grouped.join(large, "component", "left_anti")
    for x in "ab":
        grouped = grouped.join(mentions.select(F.col("form").alias(f"form_{x}"), F.col("mentions").alias(f"mentions_{x}")), f"form_{x}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of components; the last one of a batch may go on in the next
        linked: dict[str, str] = {}
        pairs_of: dict[tuple[str, str], float] = {}
        counts: dict[str, int] = {}
        at = None
        for batch in batches:
            for component, a, b, cosine, n_a, n_b in zip(*(batch.column(c).to_pylist() for c in columns)):
                if component != at:
                    linked.update(average_linkage(counts, pairs_of))
                    at, pairs_of, counts = component, {}, {}
                pairs_of[a, b] = cosine
                counts[a], counts[b] = n_a, n_b
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(linked), list(linked.values()))], names=["form", "cluster"])
            linked = {}
        linked = average_linkage(counts, pairs_of)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(linked), list(linked.values()))], names=["form", "cluster"])

    columns = ["component", "form_a", "form_b", "cosine", "mentions_a", "mentions_b"]
    # the rows are few but each component costs Python time: spread them over the cores, which coalescing would undo
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    near = grouped.select(*columns).repartition(parts, "component").sortWithinPartitions("component").mapInArrow(work, "form string, cluster string")
    return near.union(far) if several else near


def resolve(found: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``form, cluster`` of every form with one meaning, and ``form, cluster`` of all meanings of the others."""
    pairs, meant = similar_forms(found)
    meant = checkpointed(meant)
    mentions = found.join(counts, ["raw", "hint"]).groupBy("form").agg(F.sum("n").alias("mentions"))
    grouped = checkpointed(clusters(pairs, checkpointed(mentions)))
    every = found.select("form", is_open(F.col("block")).alias("open"), F.col("block").contains("?").alias("unsure")).distinct()
    every = checkpointed(every.join(grouped, "form", "left").withColumn("cluster", F.coalesce("cluster", "form")))
    full = every.where("not open").select("form", "cluster")
    best = meant.groupBy("open").agg(F.min("edits").alias("least"))
    could = meant.join(best, "open").where("edits = least").join(full.withColumnRenamed("form", "full"), "full").select(F.col("open").alias("form"), "cluster").distinct()
    count = could.groupBy("form").agg(F.count("*").alias("meanings"))
    could = checkpointed(could.join(count, "form"))
    # open forms without any full one stand for themselves, with those of the same open block that are like them
    alone = every.where("open and not unsure").join(could.select("form").distinct(), "form", "left_anti").select("form", "cluster")
    return full.union(could.where("meanings = 1").select("form", "cluster")).union(alone), could.where("meanings > 1").select("form", "cluster")


def linked(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity_id, cluster`` of the rows and ``kind, rel_id, cluster`` of the endpoints that are no row's name."""
    names, aliases, ends = spellings(entities, relationships)
    raws = names.select("raw", "hint").union(aliases.select("raw", "hint")).union(ends.select("raw", "hint"))
    counts = checkpointed(raws.groupBy("raw", "hint").agg(F.count("*").alias("n")))
    found = checkpointed(forms(counts))
    sure, several = resolve(found, counts)
    sure, several = checkpointed(sure), checkpointed(several)
    form = found.select("raw", "hint", "form")
    rows = names.join(form, ["raw", "hint"]).select("entity_id", "form")
    told = rows.join(sure, "form").select("entity_id", "cluster")
    # a row whose name can mean several: one of them is decided by its aliases
    by_alias = aliases.join(form, ["raw", "hint"]).select("entity_id", "form").join(sure, "form").select("entity_id", "cluster").distinct()
    decided = rows.join(several, "form").select("entity_id", "cluster").join(by_alias, ["entity_id", "cluster"]).groupBy("entity_id")
    decided = decided.agg(F.min("cluster").alias("cluster"), F.count_distinct("cluster").alias("n")).where("n = 1").select("entity_id", "cluster")
    touched = ends.join(form.where("hint = ''").select("raw", "form"), "raw").join(sure, "form").select("kind", "rel_id", "cluster")
    return told.union(decided).distinct(), touched.distinct()


def same_names(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``kind, key_a, key_b``: pairs of rows that denote the same, and rows with the endpoints that denote the same.

    The rows of a cluster of more than ``MOST_TOGETHER`` rows meet in parts, so that no task holds a whole hot cluster."""
    rows, ends = linked(entities, relationships)
    rows = checkpointed(rows)
    size = rows.groupBy("cluster").agg(F.ceil(F.count("*") / MOST_TOGETHER).alias("parts"))
    sized = rows.join(size, "cluster")
    a = sized.select("cluster", F.pmod(F.xxhash64("entity_id"), "parts").alias("part"), F.col("entity_id").alias("key_a"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    b = sized.select("cluster", every, F.col("entity_id").alias("key_b"))
    entity = a.join(b, ["cluster", "part"]).where("key_a < key_b").select(F.lit("entity").alias("kind"), "key_a", "key_b")
    touched = ends.join(size, "cluster").select("kind", "cluster", "rel_id", every).join(a, ["cluster", "part"])
    return entity.union(touched.select("kind", "key_a", F.col("rel_id").alias("key_b"))).distinct()
