"""Pairs that the last join of lists forms: few where texts share much but do not link, and none that links is lost."""

import random

import pytest

from lendscope.llm import jaccard_join as J


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    """The smallest doc_id that each document reaches by links."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def test_texts_with_a_common_part_are_not_paired_with_each_other(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(119))                   # 115 shingles of all; 25 of each text's own
    rows = [(n, common + " " + " ".join(f"o{n}x{i}" for i in range(25))) for n in range(80)]
    paired = []

    def count(pairs, sketches):
        paired.append(pairs.count())
        return pairs

    monkeypatch.setattr(J, "plausible", count)
    out = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == set(range(80))
    assert paired[-1] <= 80                                          # of 3160 pairs


@pytest.mark.parametrize("turns", [0, 4])
def test_no_link_near_the_bound_is_lost(spark, monkeypatch, turns):
    monkeypatch.setattr(J, "ROUNDS", turns)                          # 0: every link is found by the last join
    rnd, rows = random.Random(3), []
    for base in range(12):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 12, 30, 80, 200]))]
        for _ in range(8):
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                at = rnd.randrange(len(w))
                w[at:at + rnd.randint(0, 2)] = [f"n{rnd.randint(0, 30)}"] * rnd.randint(0, 2)
            if rnd.random() < 0.3:
                w = w[:max(1, int(len(w) * rnd.uniform(0.75, 1)))]
            rows.append((len(rows), " ".join(w)))
    rows = [(i, t) for i, t in rows if t]
    out = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(rows)


def test_rows_with_their_keys_are_matched_once(spark, monkeypatch):
    """Each join or exchange of these rows sends about half of the input again."""
    rows = [(n, " ".join(f"w{n // 2}x{i}" for i in range(40))) for n in range(60)]
    plans, store = [], J.materialize

    def keep(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *more)

    monkeypatch.setattr(J, "materialize", keep)
    out = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {n: n // 2 * 2 for n, _ in rows}
    assert sum("keys#" in p and ("LeftSemi" in p or "LeftAnti" in p) for p in plans) == 1
