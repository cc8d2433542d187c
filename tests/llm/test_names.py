"""Names: no length, list or hot group loses a link, and each step equals its brute force."""

import itertools
import random

import pytest

from graphweave.llm import names


def _tables(spark, rows, edges=()):
    entities = spark.createDataFrame([(i, n, t, None) for i, n, t in rows], "entity_id long, name string, type string, aliases array<string>")
    return entities, spark.createDataFrame(list(edges), "rel_id long, source_entity string, target_entity string")


def test_short_and_single_names():
    assert names.parse("Anna Kim", "P")[2] == "kim" and names.parse("Bo Li", "P")[2] == "li"
    assert names.parse("Madonna", "P") == ("P", "-", "madonna") and names.parse("Madonna") is None
    assert names.parse("HP Inc.", "O") == ("O", "*", "hp") and names.parse("3M", "O") == ("O", "*", "3m")
    assert names.parse("N/A", "O") is None and names.parse("the company", "O") is None
    assert names.guess("Mensah, Kwame") == names.guess("Kwame Mensah") == ("P", "kwame?", "mensah") and names.guess("Mensah") is None


def test_names_that_no_list_knows(spark):
    rows = [
        (1, "Priyanka Raghunathan", "PERSON"), (2, "Priyanak Raghunathan", "PERSON"), (3, "Raghunathan Priyanka", "PERSON"), (4, "Anna Kim", "PERSON"),
        (5, "Kim, Anna", "PERSON"), (6, "Anna Kin", "PERSON"), (7, "Zentrix Ltd", "ORG"), (8, "Zentrx Ltd", "ORG"), (9, "Madonna", "PERSON"), (10, "MADONNA", "PERSON"),
    ]
    found = {tuple(r) for r in names.same_names(*_tables(spark, rows, [(50, "Raghunathan, Priyanka", "3M")])).collect()}
    people = {("entity", a, b) for a, b in [(1, 2), (1, 3), (2, 3), (4, 5), (7, 8), (9, 10)]}
    assert found == people | {("source", i, 50) for i in (1, 2, 3)}


def _cosine(rows, a, b):
    weights = [{r.gram: r.weight for r in rows if r.form == x} for x in (a, b)]
    norms = [sum(w * w for w in x.values()) ** 0.5 for x in weights]
    return sum(w * weights[1].get(g, 0) for g, w in weights[0].items()) / norms[0] / norms[1]


def test_join_finds_every_pair_of_the_cosine(spark, monkeypatch):
    draw = random.Random(3)
    cores = ["".join(draw.choice(["ka", "lo", "min", "tre", "su"]) for _ in range(4)) for _ in range(12)]
    cores += [c[:k] + draw.choice("xyz") + c[k + 1 :] for c in cores for k in (1, 4, 6)] + [c[:3] + c[4] + c[3] + c[5:] for c in cores]
    forms = sorted({(b, c) for c in cores for b in ("peter", "paul")})
    found = spark.createDataFrame([("P", b, c, f"P/{b}/{c}", "r", "P") for b, c in forms], "kind string, block string, core string, form string, raw string, hint string")
    near = spark.createDataFrame([(x[0], x[1], y[0], y[1]) for x, y in itertools.combinations(forms, 2)], "ba string, ca string, bb string, cb string")
    near = {(f"P/{r.ba}/{r.ca}", f"P/{r.bb}/{r.cb}") for r in near.where("ba = bb").where(names._near(names.F.col("ca"), names.F.col("cb"))).collect()}
    rows = names.vectors(found).collect()
    expect = {(a, b) for a, b in near if _cosine(rows, a, b) >= names.LEAST_COSINE}
    for together in (names.MOST_TOGETHER, 3):
        monkeypatch.setattr(names, "MOST_TOGETHER", together)
        pairs = names.similar_forms(found)[0].collect()
        assert {(r.form_a, r.form_b) for r in pairs} == expect and expect < near
        assert all(abs(r.cosine - _cosine(rows, r.form_a, r.form_b)) < 1e-9 for r in pairs[:20])


def test_rounds_give_the_groups_of_one_task(spark, monkeypatch):
    draw = random.Random(8)
    for case in range(3):
        forms = [f"n{i:02}" for i in range(24)]
        mentions = {f: draw.randrange(1, 20) for f in forms}
        pairs = {(a, b): round(draw.uniform(0.3, 1), 6) for a, b in itertools.combinations(forms, 2) if draw.random() < 0.25}
        touched = {x for p in pairs for x in p}
        expect = names.average_linkage({f: mentions[f] for f in touched}, pairs)
        frame = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "form_a string, form_b string, cosine double")
        counted = spark.createDataFrame(list(mentions.items()), "form string, mentions long")
        for most in (1000, 5):
            monkeypatch.setattr(names, "MOST_IN_TASK", most)
            got = {r.form: r.cluster for r in names.clusters(frame, counted).collect()}
            groups = lambda of: {frozenset(f for f in of if of[f] == c) for c in of.values()}
            assert groups(got) == groups(expect), (case, most)


@pytest.mark.parametrize("together", [2, 2000])
def test_hot_cluster_meets_in_parts(spark, monkeypatch, together):
    monkeypatch.setattr(names, "MOST_TOGETHER", together)
    rows = [(i, n, "PERSON") for i, n in enumerate(["Peter Malonit", "Malonit, Peter", "Pete Malonit", "Peter Malonit", "Dr. Peter Malonit"])]
    found = [tuple(r) for r in names.same_names(*_tables(spark, rows, [(9, "PETER MALONIT", "x"), (9, "PETER MALONIT", "x")])).collect()]
    assert sorted(found) == sorted([("entity", a, b) for a in range(5) for b in range(a + 1, 5)] + [("source", a, 9) for a in range(5)])
