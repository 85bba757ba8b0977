"""op11, op12 and op13 on awkward rows against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from lendscope.llm import hard_negatives as hn
from lendscope.llm import importance_resampling as ir
from lendscope.llm import segment_search as ss
from lendscope.llm import vector_blocks as vb

SCHEMA = ("vec_id long, embedding array<double>, label int, row string, id int, v long, slice int, block string, ask int, "
          "q_row int, score string, y double, rank int")


def _vectors(n=160, d=20, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d))
    out = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    out[7] = (7, None, 1)
    out[8] = (8, [None] + out[8][1][1:], 1)
    out[9] = (9, [float("nan")] + out[9][1][1:], 1)
    out[10] = (10, [float("inf")] + out[10][1][1:], 1)
    out[11] = (11, out[11][1], None)
    out[50] = (50, out[50][1], None)
    hot = out[100][1]
    out += [(200 + i, hot, 1) for i in range(60)]                 # a third of the rows is one vector
    out += [(300, hot, 2), (300, hot, 2), (None, hot, 0), (None, None, 0)]
    out += [(350 + i, [float(i)] * 3, i % 2) for i in range(6)]   # other lengths
    out += [(400, [], 1), (401, [], 1), (402, [], 2)]
    out += [(450, [1e30, -1e30], 1), (451, [1e30, 3.0], 1), (452, [0.5e30, 1.0], 2), (453, [-1e30, 2.0], 2), (454, [1e307, 1.0], 1)]
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "r", 1, 2, 3, "b", 4, 5, "s", 0.5, 6) for i, v, lab in rows], SCHEMA).repartition(5)


def _whole(rows):
    out = []
    for i, v, lab in rows:
        if v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        out.append((i, [math.floor(256 * x) for x in v], lab))
    return out


def _score(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63) + 1), (1 << 63) - 1)


def _ordered(pairs):
    return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] or 0))


@pytest.fixture(params=[None, 16])
def block(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(vb, "BLOCK_ROWS", request.param)       # many slices and query blocks


def test_top_k_equals_brute_force(spark, block):
    rows = _vectors()
    whole, want = _whole(rows), Counter()
    for a, (qi, qv, _) in enumerate(whole):
        if qi is not None and qi % 50 == 0:
            found = _ordered((_score(qv, v), i) for b, (i, v, _) in enumerate(whole) if a != b and len(v) == len(qv))
            want.update((qi, r + 1, i, s) for r, (s, i) in enumerate(found[:5]))
    got = Counter(tuple(r) for r in ss.top_k(_frame(spark, rows)).collect())
    assert got == want and sum(got.values()) > 30


def _negatives(rows, divisor, noise):
    every, classes = noise
    whole = [(i, v, (lab + 1) % classes if i is not None and i % every == 0 else lab) for i, v, lab in _whole(rows) if lab is not None]
    want = Counter()
    for a, (ai, av, al) in enumerate(whole):
        if ai is None or ai % divisor:
            continue
        others = [(_score(av, v), i, lab) for b, (i, v, lab) in enumerate(whole) if a != b and len(v) == len(av)]
        for ps, pi in _ordered((s, i) for s, i, lab in others if lab == al)[:5]:
            found = _ordered((s, i) for s, i, lab in others if lab != al and 80 * ps <= 100 * s <= 100 * ps)
            want.update((ai, pi, r + 1, ni, ps, s) for r, (s, ni) in enumerate(found[:5]))
    return want


def test_hard_negatives_equal_brute_force(spark, block):
    rows = _vectors()
    rows += [(500 + i, [0.1 * i, 1.0, -0.5], i % 3) for i in range(40)]
    want = _negatives(rows, 10, (7, 3))
    got = Counter(tuple(r) for r in hn.mine(_frame(spark, rows), divisor=10, noise=(7, 3)).collect())
    assert got == want and sum(got.values()) > 50


@pytest.mark.parametrize("rows", [[], [(50, None, 1)], [(50, [1.0], 1)], [(100, [], 1), (100, [], 1), (1, [], 2)]])
def test_tables_of_few_rows(spark, rows):
    frame = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int")
    top, mined = ss.top_k(frame).collect(), hn.mine(frame).collect()
    assert len(top) == (4 if len(rows) == 3 else 0)                # two queries, two others each
    assert len(mined) == (2 if len(rows) == 3 else 0)              # score 0: 0 <= 0 <= 0


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e7, 1e12])
@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_packed_products_are_exact(scale, d):
    rnd = np.random.default_rng(d)
    q, x = np.floor(rnd.normal(size=(9, d)) * scale), np.floor(rnd.normal(size=(23, d)) * scale)
    x[0], q[0], x[1] = 0, 0, -abs(x[1])
    want = [[_score([int(v) for v in a], [int(v) for v in b]) for b in x] for a in q]
    assert hn.packed_products(q, x).tolist() == want == vb.exact_products(q, x).tolist()


def test_several_candidates_share_a_word():
    q = np.floor(np.random.default_rng(1).normal(size=(50, 64)) * 32)
    reach = hn._total(q) * 320
    assert hn.WORD_BITS // (2 * reach + 1).bit_length() >= 3


@pytest.mark.parametrize("d", [1, 3, 8, 64, 100])
def test_bounds_never_lose_a_pair(d):
    rnd = np.random.default_rng(d)
    centre = np.repeat(rnd.normal(size=(6, -(-d // 8))), 8, axis=1)[:, :d] * 200      # smooth vectors: coarse levels decide
    q, x = (np.floor(centre[rnd.integers(0, 6, n)] + rnd.normal(size=(n, d)) * 9) for n in (40, 300))
    exact = (q @ x.T).astype(np.int64)
    lowest = np.sort(exact, axis=1)[:, -5]
    got = ss.bounded_products(q, x, lowest)
    reached = exact >= lowest[:, None]
    assert (got[reached] == exact[reached]).all() and ((got == exact) | (got == vb.LEAST)).all()
    if d >= 8:
        assert (got == vb.LEAST).mean() > 0.3


@pytest.mark.parametrize("segments", [1, 4, 5])
def test_segment_bounds(segments):
    rnd = np.random.default_rng(segments)
    a, b = rnd.normal(size=(30, 13)), rnd.normal(size=(40, 13))
    sa, sb = ss.statistics(a, segments), ss.statistics(b, segments)
    assert sa.shape == (30, 2 * segments) and (sa @ sb.T >= a @ b.T - 1e-9).all()
    gap = ((a[:, None] - b[None]) ** 2).sum(2) - ((sa[:, None] - sb[None]) ** 2).sum(2)
    assert gap.min() > -1e-9


# --- importance resampling -------------------------------------------------------------------------

def _runs(text, n):
    ws = fx.words(text)
    return len(ws), [" ".join(ws[i:i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_hash_as_zlib(n):
    texts = [t or "" for _, t in fx.texts()]
    doc, bucket, count = ir.features([t.encode() for t in texts], n, ir.BUCKETS)
    got = defaultdict(Counter)
    for d, b in zip(doc, bucket):
        got[int(d)][int(b)] += 1
    for i, t in enumerate(texts):
        k, runs = _runs(t, n)
        assert count[i] == k and got[i] == Counter(zlib.crc32(r.encode()) % ir.BUCKETS for r in runs)


def _resampled(rows, items, percent, min_words, n, k):
    def counted(texts):
        c = Counter(zlib.crc32(r.encode()) % k for t in texts for r in _runs(t, n)[1])
        return c, sum(c.values())

    (s, ss_), (t, tt) = counted(x for _, x in rows), counted(x for _, x in items)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss_ + k) / ((s[b] + 1) * (tt + k)))) for b in range(k)]
    out = []
    for i, x in rows:
        words, runs = _runs(x, n)
        total = [gain[zlib.crc32(r.encode()) % k] for r in runs]
        w = sum(total) // len(total) if total else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(runs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): p + 1 for p, r in enumerate(able[:len(able) * percent // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("percent, n", [(10, 1), (60, 2), (100, 1), (0, 1)])
def test_resampling_equals_brute_force(spark, percent, n):
    rows = fx.texts() + [(14, "one two three four five " * 5)] * 3 + [(None, "same words of a row without an id " * 4)] * 40
    got = ir.resample(fx.docs(spark, rows).repartition(4), fx.bench(spark), percent=percent, n=n, buckets=997)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = Counter(tuple(r) for r in got.collect())
    assert got == _resampled(rows, [(i, t) for i, t in fx.ITEMS], percent, 20, n, 997)


def test_resampling_of_empty_tables(spark):
    assert ir.resample(fx.docs(spark, []), fx.bench(spark)).collect() == []
    rows = [(i, f"word{i} " * 30) for i in range(20)]
    got = Counter(tuple(r) for r in ir.resample(fx.docs(spark, rows), fx.bench(spark, [])).collect())
    assert got == _resampled(rows, [], 10, 20, 1, ir.BUCKETS)


@pytest.mark.parametrize("margin, accuracy", [(1e-6, 2), (1e-6, 10_000), (0.4, 3)])
def test_bracket_holds_the_cutoff(spark, margin, accuracy):
    scores = [(i * 7919) % 4001 if i % 3 else 500 for i in range(3000)]         # a third of the scores is one value
    rows = spark.createDataFrame([(s,) for s in scores], "score long").repartition(7)
    order = sorted(scores, reverse=True)
    for m in (1, 2, 299, 1500, 2600, 2999, 3000):
        low, high, above = ir.bracket(rows, m, len(scores), margin, accuracy)
        assert low <= order[m - 1] <= high and above == sum(s > high for s in scores)


def test_ranks_are_gapless_among_equal_rows(spark):
    rows = spark.range(500).select(F.lit(5).alias("score"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("n_features"),
                                   F.lit(2).alias("tie"), F.col("id").alias("row"))
    got = ir.ranked(rows).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501)) and all(r["rank"] == r["row"] + 1 for r in got)
