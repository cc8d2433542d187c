"""Look-alikes of rarer scripts, loaded tables and hot classes."""

import pytest

from graphweave.llm import confusables, textnorm
from graphweave.llm.textnorm import load_confusables, skeleton


def test_rare_scripts_and_types():
    for seen, plain in [("𝐩𝐚𝐬𝐬", "pass"), ("ℎ", "h"), ("Ⅰ", "I"), ("Ꭺ", "A"), ("օ", "o"), ("ⲣ", "p"), ("ꓮꓦ", "AV"), ("ſ", "f"), ("𝟏𝛂", "1a"), ("ｐ", "p")]:
        assert skeleton(seen) == plain
    assert skeleton("²") != "2" and skeleton("𝟏") != skeleton("2") and skeleton("ⓟ") != "p"
    pairs = textnorm.RARE_LOOK_ALIKES.split()
    assert all(len(p) == 2 and p[1].isascii() for p in pairs)


def test_loaded_table(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("\ufeff# remark\n24DF ;\t0070 ;\tMA\t# p\n\n006D ; 0072 006E ; MA\n")
    assert load_confusables(str(path)) == {0x24DF: "p", 0x6D: "rn"}
    df = spark.createDataFrame([(1, "ⓟam"), (2, "parn"), (3, None)], "doc_id long, text string")
    hashes = {r.doc_id: bytes(r.skeleton_hash) for r in confusables.skeletons(df, str(path)).collect()}
    assert hashes[1] == hashes[2] and len(hashes) == 2
    plain = {r.doc_id: bytes(r.skeleton_hash) for r in confusables.skeletons(df).collect()}
    assert plain[1] != plain[2]


@pytest.mark.parametrize("together", [3, 100_000])
def test_hot_classes(spark, monkeypatch, together):
    monkeypatch.setattr(confusables, "MOST_TOGETHER", together)
    rows = [(i, "pass") for i in range(20)] + [(50 + i, "раѕѕ") for i in range(7)] + [(90, "other"), (91, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:3]], "doc_id long, text string, part int")
    found = [tuple(r) for r in confusables.look_alike_pairs(df).collect()]
    assert sorted(found) == sorted((a, b) for a in range(20) for b in range(50, 57))
    held = [(r.doc_id, r.class_id, r.class_texts) for r in confusables.classes(df).collect()]
    assert sorted(held) == sorted([(i, 0, 2) for i, _ in rows[:27]] + [(90, 90, 1)])
