"""Small cases of the numbered problems: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweave.llm import confusables, language, leakage, names, neighbours, ocr, splitting, tokenizer
from graphweave.llm.textnorm import skeleton

VOCABULARY = tokenizer.DEFAULT_VOCABULARY


# 8


def test_skeletons():
    assert skeleton("Ｆｕｌｌ") == skeleton("Full") == skeleton("Fu​ll") == skeleton("Fuɩl".replace("ɩ", "l"))
    assert skeleton("résumé") == skeleton("résumé") != skeleton("resume")
    assert skeleton("раѕѕ") == skeleton("pass") and skeleton("ﬁt") == skeleton("fit")
    assert skeleton("a b‐c") == skeleton("a b-c") and skeleton("1") != skeleton("2") and skeleton("²") != skeleton("2")
    assert skeleton(None) is None and skeleton(" ​") == "" and skeleton("👩‍🔧") != skeleton("👩🔧")


def test_look_alike_pairs(spark):
    rows = [(1, "pass"), (2, "раѕѕ"), (3, "pass"), (3, "pass"), (4, None), (5, ""), (6, "​"), (7, "PASS"), (8, "x" * 5000), (9, "x" * 4999 + "ｘ")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, skeleton string")
    assert {tuple(r) for r in confusables.look_alike_pairs(df).collect()} == {(1, 2), (2, 3), (8, 9)}
    assert {(r.doc_id, r.class_id, r.class_texts) for r in confusables.classes(df).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 1), (8, 8, 2), (9, 8, 2)}
    assert confusables.look_alike_pairs(df.limit(0)).count() == 0


# 6


def test_encoding_equals_the_library(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    draw = random.Random(5)
    texts = ["", None, "a", "aaaaaaaaaaaaa", "  two  spaces \n\n\t x", "<|endoftext|> it's", "日本語 한국어 ру́сский 🙂", "x" * 3000, "".join(draw.choice("ab ") for _ in range(2000))]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x500)])) for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    found = {r.doc_id: r.ids for r in tokenizer.encode_documents(df, VOCABULARY).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert all(library.decode(found[i], skip_special_tokens=False) == t for i, t in enumerate(texts) if t)
    assert tokenizer.encode_documents(df.limit(0), VOCABULARY).count() == 0


# 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#|-é", max_size=400), st.integers(2, 20), st.data())
def test_pieces_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = list(splitting.split_item(text, ["H"], limit, overlap))
    tokens = len(splitting.TOKEN.findall(text))
    assert bool(pieces) == bool(tokens)
    assert "".join(text[core:end] for _, core, end, _, _ in pieces) == (text if pieces else "")
    for start, core, end, n, _ in pieces:
        assert n == len(splitting.TOKEN.findall(text[start:end])) <= max(limit, 1)
        assert len(splitting.TOKEN.findall(text[start:core])) <= overlap


def test_cuts_at_headings_and_keeps_hierarchy(spark):
    text = "one two three four five.\n\n## Part B\nsix seven eight nine ten."
    rows = [("c", text, ["T", "A"], 1), ("c", text, ["T", "A"], 2), ("small", "x", None, 1), ("null", None, None, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading_hierarchy array<string>, ingested_at int")
    found = splitting.pieces(df, 9, 2).orderBy("piece_no").collect()
    assert [r.chunk_id for r in found] == ["c", "c"] or len(found) > 2
    second = next(r for r in found if text[r.core_char :].startswith("## Part B"))
    assert second.heading_hierarchy == ["T", "Part B"] and max(r.token_count for r in found) <= 9
    assert {r.chunk_id for r in splitting.oversized_ids(df, 9, 2).collect()} == {"c"}
    with pytest.raises(ValueError):
        splitting.pieces(df, 5, 5)


# 2


SAMPLES = {
    "en": "The field team collects the samples before the morning handover and writes a short note for the next crew. ",
    "de": "Die Nachtschicht prüft den Druck in allen Leitungen und schreibt eine kurze Notiz für die nächste Gruppe. ",
    "fr": "Le service des archives remplace les joints usés et vérifie la pression dans toutes les conduites du dépôt. ",
    "ru": "Полевая группа сверяет показания с бумажным журналом и пишет короткую заметку для следующей бригады. ",
}


def test_languages(spark):
    samples = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(SAMPLES.items())], "sample_id long, lang string, text string")
    rows = [
        (1, "f1", SAMPLES["en"] * 2), (2, "f2", SAMPLES["en"] * 2), (3, "f3", f"# H\n\n{SAMPLES['en'] * 3}\n \n{SAMPLES['de'] * 2}"),
        (4, "f4", None), (5, "f5", "too short"), (6, "f6", SAMPLES["ru"] * 200), (6, "f6", SAMPLES["ru"] * 200),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, file_hash string, text string, lang string")
    labels = [("f1", "English", 1), ("f2", "en", 1), ("f2", "de-AT", 2), ("f3", "en_US", 1), ("f4", None, 1), ("f5", "??", 1)]
    metadata = spark.createDataFrame(labels, "file_hash string, language string, ingested_at int")
    found = {tuple(r) for r in language.wrong_languages(docs, metadata, samples).collect()}
    assert found == {(2, -1, "en"), (3, -1, "en"), (3, 2, "de"), (6, -1, "ru")}
    sure = language.document_languages(docs, language.fit_profiles(samples)).where("seg_no = -1").collect()
    assert {r.doc_id: r.lang for r in sure}[4] is None and all(r.confidence > 0.5 for r in sure if r.lang)
    assert language.wrong_languages(docs.limit(0), metadata, samples).count() == 0


def test_held_out_languages():
    texts = [t * 3 for t in SAMPLES.values()]
    profiles = language.Profiles().fit(texts, list(SAMPLES))
    scores, letters, length = profiles.compare(["the team writes the note and the crew collects", "Die Gruppe prüft die Leitungen und den Druck"])
    assert (abs(scores) <= 1.01).all() and [profiles.codes[i] for i in scores.argmax(1)] == ["en", "de"] and (letters > 30).all() and (length > 1).all()


def test_languages_come_from_the_samples(spark):
    own = {"eo": "La laboristoj kolektas la specimenojn antau la matena kunveno kaj skribas mallongan noton por la sekva teamo. ", "en": SAMPLES["en"]}
    samples = spark.createDataFrame([(i, k, t * 3) for i, (k, t) in enumerate(own.items())], "sample_id long, lang string, text string")
    docs = spark.createDataFrame([(1, "f", own["eo"]), (2, "g", own["en"]), (3, "h", None)], "doc_id long, file_hash string, text string")
    metadata = spark.createDataFrame([("f", "eo", 1), ("g", "eo", 1)], "file_hash string, language string, ingested_at int")
    assert {tuple(r) for r in language.wrong_languages(docs, metadata, samples).collect()} == {(2, -1, "en")}
    assert language.wrong_languages(docs, metadata, samples.limit(0)).count() == 0
    assert language.wrong_languages(docs, metadata, samples.where("lang = 'eo'")).where("lang != 'eo'").count() == 0


# 7


ITEM = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(40))


def test_leaks(spark):
    parts = ITEM.split()
    wrong = " ".join("oops" if i % 9 == 4 else w.upper() for i, w in enumerate(parts))
    rows = [
        (1, f"before **{ITEM}** after"), (2, " ".join(parts[:15])), (3, " ".join([*parts[:14], *["filler"] * 30, *parts[25:37]])), (4, wrong),
        (5, " ".join(parts[:8] + ["x"] * 9 + parts[8:16] + ["y"] * 9 + parts[16:24])), (6, None), (7, ""), (8, ITEM.replace("o", "о")), (8, ITEM),
    ]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "two words")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (3, 1), (4, 1), (8, 1)}
    assert {r.doc_id for r in leakage.clean(docs, items).collect()} == {2, 5, 6, 7}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


# 3


def test_nearest_against_brute_force(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 64))
    vectors = (centres[draw.integers(0, 30, 400)] + 0.3 * draw.normal(size=(400, 64))).astype(np.float32)
    vectors[10:20] = vectors[10]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0] * 32), (3, vectors[3].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "entity_id long, embedding array<float>, rank int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    found = neighbours.nearest(df, 5).collect()
    right = 0
    for q in range(400):
        scores = np.round(unit @ unit[q], 6)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:5]
        right += len({r.other_id for r in found if r.entity_id == q} & set(best))
    assert right / 2000 >= 0.97 and len(found) == 2000
    assert neighbours.nearest_pairs(df.limit(0)).count() == 0


# 1


def test_parse():
    assert names.parse("Dr. Peggy M. Zorblax") == names.parse("Zorblax, Margaret") == ("P", "margaret", "zorblax")
    assert names.parse("The Zorblax Labs Inc.") == names.parse("Laboratories, Zorblax") == ("O", "laboratories", "zorblax")
    assert names.parse("Z. Zorblax") == ("P", "z*", "zorblax") and names.parse("Flow Probe") is None and names.parse("  ") is None


def test_average_linkage():
    linked = names.average_linkage({"a": 10, "b": 1, "c": 1, "z": 5}, {("a", "b"): 0.6, ("a", "c"): 0.5})
    assert linked["a"] == linked["b"] == linked["c"] != linked["z"]


def test_same_names(spark):
    rows = [
        (1, "Margaret Zorblaxi", "PERSON", None), (2, "Zorblaxi, Peggy", "person ", []), (3, "Margaret Zorblxai", "PERSON", [None, ""]), (4, "Robert Zorblaxi", "PERSON", []),
        (5, "Quandor Labs", "ORG", []), (6, "Quandor Laboratories Ltd.", "Company", []), (7, "Quandor Foods", "ORG", []), (8, None, "ORG", []), (9, "Margaret Zorblaxi", "PRODUCT", []), (1, "Margaret Zorblaxi", "PERSON", None),
    ]
    entities = spark.createDataFrame([(*r, "k") for r in rows], "entity_id long, name string, type string, aliases array<string>, kind string")
    edges = [(100, "M. Zorblaxi", "QUANDOR LABORATORIES"), (101, "Margaret Zorblaxi", None), (102, "Nobody Known", "Quandor Foods Inc"), (102, "Nobody Known", "Quandor Foods Inc")]
    relationships = spark.createDataFrame(edges, "rel_id long, source_entity string, target_entity string")
    found = {tuple(r) for r in names.same_names(entities, relationships).collect()}
    people = {("entity", 1, 2), ("entity", 1, 3), ("entity", 2, 3)} | {("source", i, 100) for i in (1, 2, 3)}
    firms = {("entity", 5, 6), ("target", 5, 100), ("target", 6, 100), ("target", 7, 102)}
    assert found == people | firms
    assert names.same_names(entities.limit(0), relationships.limit(0)).count() == 0


# 5


def test_noise(spark):
    prose = "The field team collects samples from the lower basin before the morning handover and the crew"
    digital = " ".join([prose] * 6) + " one page low power standard"
    lines = [
        "[Manual > Part]", "The field team collects sam-", "ples from the lower basin before the", "Quandor Labs · Operating Manual", "p. 7",
        "morning handover and tbe crew of the", "lower basin collects the samples for", "the field team before the morning low-", "power handover and the crew of basin",
    ]
    rows = [("f", "c1", "\n".join(lines), []), ("f", "c1", "\n".join(lines), []), ("g", "c2", digital, None), ("g", "c3", None, None), ("g", "c4", "", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_hash string, chunk_id string, text string, heading_hierarchy array<string>, noise string")
    assert {tuple(r) for r in ocr.noise(df).collect()} == {("c1", "hyphen"), ("c1", "header"), ("c1", "pageno"), ("c1", "misread")}
    assert ocr.noise(df.limit(0)).count() == 0
    texts = {r.chunk_id: r.text for r in ocr.repaired(df).collect()}
    assert texts["c1"] == "[Manual > Part]\nThe field team collects samples from the lower basin before the morning handover and the crew of the lower basin collects the samples for the field team before the morning low-power handover and the crew of basin"
    assert texts["c2"] == digital and texts["c4"] == "" and "c3" not in texts
    assert ocr.fold_line("12 | Frcight Report") == ocr.fold_line("Freight Report   3") and ocr.fold_line("© 2006 A") == ocr.fold_line("© 2007 A")
