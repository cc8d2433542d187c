import numpy as np
import pytest

from graphweave.llm import leakage
from graphweave.llm.leakage import RUN, SuffixArray, held_words


def test_many_other_passages_do_not_split_one():
    places = [(0, 0, 48)] + [(1000 + 20 * i, d, RUN) for d in (15, 30) for i in range(50)]
    assert held_words(places) == 48
    # the one passage is continued over gaps, whatever began meanwhile
    gaps = [(10 * i, 10 * i, 8) for i in range(5)] + [(1000 + 20 * i, d, RUN) for d in (9, 19, 29) for i in range(60)]
    assert held_words(gaps) == 48


def _common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters, depth", [(2, 64), (4, 64), (30, 64), (1, 64), (3, 7)])
def test_suffix_array_against_brute_force(letters, depth):
    draw = np.random.default_rng(letters)
    train, owner = draw.integers(0, letters, 240).astype(np.uint64), np.repeat(np.arange(6), 40)
    test, of = draw.integers(0, letters + 1, 60).astype(np.uint64), np.repeat(np.arange(10), 6)
    array = SuffixArray(train, owner, depth)
    ends, t_ends = np.searchsorted(owner, owner, "right"), np.searchsorted(of, of, "right")
    if depth >= 40:
        suffixes = [tuple(train[p : ends[p]]) for p in array.order]
        assert suffixes == sorted(suffixes)
    best, at = array.longest(test, of)
    for i in range(60):
        length = [_common(test[i : t_ends[i]], train[p : ends[p]]) for p in range(240)]
        assert best[i] == max(length) and length[array.order[at[i]]] == best[i]
    expect = set()
    for i in range(60):
        for p in range(240):
            n = _common(test[i : t_ends[i]], train[p : ends[p]])
            begun = i and p and of[i] == of[i - 1] and owner[p] == owner[p - 1] and test[i - 1] == train[p - 1]
            if n >= RUN and not begun:
                expect.add((i, p, n))
    found = list(zip(*(x.tolist() for x in array.matches(test, of))))
    assert set(found) == expect and len(found) == len(expect)


def test_any_number_of_items_gives_the_same(spark, monkeypatch):
    draw = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(draw.choice(vocabulary, 30))) for k in range(8)] + [(8, None), (9, ""), (10, "two words"), (3, " ".join(draw.choice(vocabulary, 30)))]
    docs = []
    for d in range(40):
        parts = list(draw.choice(vocabulary, 50))
        own = items[d % 8][1].split()
        at = int(draw.integers(0, 20))
        parts[at : at + 20] = own[5:25] if d % 3 else own[:8] + ["x"] + own[9:20]
        docs.append((d, " ".join(parts)))
    docs += [(40, None), (41, ""), (0, docs[0][1])]
    frames = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    once = {tuple(r) for r in leakage.leaks(*frames).collect()}, sorted(tuple(r) for r in leakage.matches(*frames).collect())
    monkeypatch.setattr(leakage, "MOST_ITEM_CHARS", 0)
    routed = {tuple(r) for r in leakage.leaks(*frames).collect()}, sorted(tuple(r) for r in leakage.matches(*frames).collect())
    assert routed == once and len(once[0]) > 10 and max(x[4] for x in once[1]) >= 11
    assert leakage.leaks(frames[0].limit(0), frames[1]).count() == 0 == leakage.matches(*frames).limit(0).count()
