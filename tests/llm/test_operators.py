"""Each operator against a brute-force version on a table of awkward rows, and on empty tables."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as X  # noqa: E402

from lendscope.llm import (bloom_dedup, decontaminate, grammar_secrets, jaccard_join, kernel_langid,  # noqa: E402
                           license_scan, line_dedup, mixing, shard_tree, suffix_dedup)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_of(df, *cols):
    return X.repeat_rows([tuple(r[c] for c in cols) for r in df.collect()])


# --- 1 mixing -----------------------------------------------------------------------------------

def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_mixing_meets_targets(spark):
    rows = [(i, ("good solid text number %d " % i) * 3 if i % 3 else "bad junk noise %d " % i) for i in range(120)]
    own = labels(spark, [(i, 1 if i % 3 else 0, 0) for i in range(0, 120, 2)] + [(1, 0, 1), (3, 0, 1), (None, 1, 0), (5, None, None), (999, 1, 0)])
    targets = {"low": 0.3, "high": 0.6, "toxic": 0.1}
    out = mixing.rates(X.docs(spark, rows), mixing.label_domain(own), targets).collect()
    assert len(out) == 120 and all(r.rate >= 0 for r in out)
    total = sum(r.n_tokens for r in out)
    for name, want in targets.items():
        assert abs(sum(r.n_tokens * r[f"p_{name}"] * r.rate for r in out) / total - want) < 0.03
    assert all(abs(r.p_low + r.p_high + r.p_toxic - 1) < 1e-9 for r in out)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in out)


def test_mixing_fold_is_projected_gradient():
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet([1, 1, 1], 200)
    a = rnd.random(200)
    a /= a.sum()
    t = np.array([0.2, 0.3, 0.5])
    pull, step, residuals = 0.05, 1 / 1.05, []
    for _ in range(200):
        _, y = mixing._folded(p, residuals, step, pull)
        residuals.append(list((a * y) @ p - t))
    r = mixing._folded(p, residuals, step, pull)[0]
    grad = p @ ((a * r) @ p - t) + pull * (r - 1)
    assert (r >= 0).all() and np.abs(grad[r > 1e-9]).max() < 1e-4 and grad[r <= 1e-9].min(initial=0) > -1e-4


def test_mixing_awkward_and_empty(spark):
    d = X.docs(spark)
    none = labels(spark, [])
    out = mixing.rates(d, mixing.label_domain(none)).collect()
    assert len(out) == len(X.texts()) and all(abs(r.p_low - 1 / 3) < 1e-12 for r in out)
    one = mixing.rates(d, mixing.label_domain(labels(spark, [(0, 1, 0), (1, 1, 0)]))).collect()
    assert all(r.p_high == 1.0 and r.p_low == 0.0 for r in one)
    two = mixing.label_domain(labels(spark, [(0, 1, 0), (17, 0, 0), (18, 0, 0), (3, 1, 0), (6, 0, 0), (14, 1, 0)]))
    mixed = mixing.mix(d, two)
    assert mixed.columns == d.columns
    got = Counter(r.doc_id for r in mixed.collect())
    said = Counter()
    for r in mixing.rates(d, two).collect():
        said[r.doc_id] += r.copies
    assert got == +said
    empty = X.docs(spark, [])
    assert mixing.rates(empty, mixing.label_domain(none)).count() == 0 and mixing.mix(empty, two).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(d, two, {})


def test_mixing_meets_targets_of_rare_and_weak_domains(spark):
    def share(p, tokens, rate, d):
        return sum(t * v[d] * r for t, v, r in zip(tokens, p, rate)) / sum(tokens)

    rnd = np.random.default_rng(4)
    soft = [[v, 0.98 * (1 - v), 0.02 * (1 - v)] for v in np.clip(rnd.normal(0.3, 0.07, 600), 0, 1)]   # variance about 0.005
    sure = [[1.0, 0.0, 0.0] if i % 100 == 0 else [0.0, 0.995, 0.005] if i % 2 else [0.0, 0.005, 0.995] for i in range(600)]
    for p, targets in ((sure, [0.05, 0.45, 0.5]), (soft, [0.4, 0.588, 0.012])):
        tokens = [int(v) for v in rnd.integers(20, 200, len(p))]
        stored = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in zip(tokens, p)], "tokens long, p array<double>")
        rate = mixing.fit_rates(stored, targets)
        got = [(r.tokens, r.p, r.rate) for r in stored.withColumn("rate", rate(F.col("p"))).collect()]
        t, v, r = zip(*got)
        assert min(r) >= 0
        for d, want in enumerate(targets):
            assert abs(share(v, t, r, d) - want) < 0.01 * want


# --- 2 sharding ---------------------------------------------------------------------------------

TREE = shard_tree.grid(2, 3, 4)


def test_shard_tree(spark):
    d = X.docs(spark, X.texts() + [(1000 + i, f"t{i}") for i in range(3000)])
    out = shard_tree.assign(d, TREE).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.5 * min(map(len, by.values()))
    grown = sum(r.grown_shard == 24 for r in out)
    assert 0.5 < grown / (len(out) / 25) < 1.6
    want = X.repeat_rows([(i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in X.texts()])
    assert X.repeat_rows([(r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is None or r.doc_id < 1000]) == want


def test_shard_weights_move_rows_only_in_their_subtree(spark):
    ids = spark.range(4000).toDF("doc_id").selectExpr("doc_id", "'x' as text")
    region, other = TREE
    rack = region.children[0]
    heavier = shard_tree.Node(rack.children[0].name, 3.0, (), rack.children[0].shard)
    changed = (shard_tree.Node(region.name, region.weight, (
        shard_tree.Node(rack.name, rack.weight, (heavier, *rack.children[1:])), *region.children[1:])), other)
    a = {r.doc_id: r.shard for r in shard_tree.assign(ids, TREE).collect()}
    b = {r.doc_id: r.shard for r in shard_tree.assign(ids, changed).collect()}
    moved = {k for k in a if a[k] != b[k]}
    assert moved and all(a[k] in range(4) and b[k] == 0 for k in moved)
    with pytest.raises(ValueError):
        shard_tree.assign(ids, ())


def test_shard_empty(spark):
    assert shard_tree.assign(X.docs(spark, []), TREE).count() == 0


# --- 3 line dedup -------------------------------------------------------------------------------

def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    a, b = sorted((a, b), key=len)
    return 1 if len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b))) else 9


def brute_lines(rows):
    seen, out = [], []
    order = sorted(set(r for r in rows if r[0] is not None)) + [r for r in rows if r[0] is None]
    for i, t in order:
        kept, equal, near = [], 0, 0
        for s in (t or "").split("\n"):
            u = s.strip(" ")
            if not u:
                kept.append(s)
                continue
            if u in seen:
                equal += 1
            elif len(u) >= line_dedup.MIN_CHARS and any(len(p) >= line_dedup.MIN_CHARS and edits(p, u) == 1 for p in seen):
                near += 1
            else:
                kept.append(s)
            seen.append(u)
        out += [(i, len(t.split("\n")) if t else 0, equal, near, sha("\n".join(kept)))] * rows.count((i, t))
    return X.repeat_rows(out)


def line_rows():
    import random
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé x") for _ in range(rnd.randint(8, 40))) for _ in range(30)]
    rows = []
    for i in range(40):
        ls = []
        for _ in range(6):
            s = rnd.choice(base)
            k, op = rnd.randrange(len(s)), rnd.random()
            s = s[:k] + "q" + s[k + 1:] if op < .3 else s[:k] + s[k + 1:] if op < .5 else s[:k] + "w" + s[k:] if op < .7 else s
            ls.append(s)
        rows.append((i, "\n".join(ls)))
    return rows + [(200, None), (201, ""), (202, "x" * 40), (203, "x" * 41), (203, "x" * 41), (None, base[0]), (204, "y" * 9000),
                   (205, "y" * 4000 + "n" + "y" * 4999)]


def test_line_dedup(spark):
    rows = line_rows()
    got = line_dedup.report(X.docs(spark, rows))
    assert rows_of(got, "doc_id", "n_lines", "n_equal", "n_near", "kept_sha256") == brute_lines(rows)
    assert line_dedup.report(X.docs(spark, [])).count() == 0


# --- 4 licenses ---------------------------------------------------------------------------------

def brute_license(t):
    ws = X.words(t)
    places, labs = [], set()
    for phrase, lab in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += at
        labs |= {lab} if at else set()
    more, best = set(), 0.0
    for line in (t or "").split("\n"):
        have = set(X.words(line))
        for lab, body in license_scan.TEMPLATES:
            need = set(X.words(body))
            if len(have & need) >= math.ceil(0.8 * len(need) - 1e-9):
                more.add(lab)
                best = max(best, len(have & need) / len(need))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labs)),
            ",".join(sorted(labs | more)), 1.0 if places else best)


def test_license_scan(spark):
    rows = X.texts() + [(300, "RELEASED under MIT, License the"), (301, "program is free software you can redistribute it and or "
                        "modify it under the terms of the GNU General Public Licence as published by the Free Software Foundation")]
    got = license_scan.scan(X.docs(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == \
        X.repeat_rows([(i, *brute_license(t)) for i, t in rows])
    assert license_scan.scan(X.docs(spark, [])).count() == 0


# --- 5 exact dedup ------------------------------------------------------------------------------

def test_bloom_dedup(spark):
    rows = X.texts() + [(400 + i, "Hot TEXT" if i % 2 else "hot text") for i in range(200)]
    by = defaultdict(list)
    for i, t in rows:
        by[X.lower(t)].append(i)
    want = []
    for i, t in rows:
        keep = max((x for x in by[X.lower(t)] if x is not None), default=None)
        want.append((i, keep, len(by[X.lower(t)]), i == keep, sha(X.lower(t))))
    got = bloom_dedup.dedup(X.docs(spark, rows))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == X.repeat_rows(want)
    assert bloom_dedup.dedup(X.docs(spark, [])).count() == 0


def test_bloom_full_filter_is_still_right(spark, monkeypatch):
    monkeypatch.setattr(bloom_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(bloom_dedup, "MAX_BITS", 64)
    out = bloom_dedup.dedup(X.docs(spark, [(i, f"t{i % 150}") for i in range(300)])).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 150 + 150 for r in out) and len(out) == 300


# --- 6 suffix arrays ----------------------------------------------------------------------------

def brute_suffix(rows):
    seen, res = set(), {}
    named = sorted({r for r in rows if r[0] is not None})
    for i, t in named:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            if w in seen:
                cov[k:k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(bool(cov[k]) and (k == 0 or not cov[k - 1]) for k in range(len(b)))
        res[(i, t)] = (i, len(b), sum(cov), spans, sha(bytes(c for c, m in zip(b, cov) if not m)))
    return X.repeat_rows([res[r] for r in rows if r[0] is not None])


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = X.texts()
    got = suffix_dedup.dedup(X.docs(spark, rows)).where("doc_id is not null")
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(rows)


def test_suffix_rows_without_id_come_last(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(X.docs(spark, [(None, t), (5, t)])).collect()}
    assert got == {5: brute_suffix([(5, t)])[0][2], None: 300}
    assert suffix_dedup.dedup(X.docs(spark, [])).count() == 0


def test_longest_previous_factor():
    group = np.array([0, 0, 0, 1, 1])
    ctx = np.frombuffer(b"abcabxabcabcabx", np.uint8).reshape(5, 3)
    words = suffix_dedup.as_words(ctx)
    assert [bytes(ctx[i]) for i in suffix_dedup.order_suffixes(group, words)] == [b"abc", b"abc", b"abx", b"abc", b"abx"]
    assert list(suffix_dedup.longest_previous_factor(group, words, np.array([7, 1, 3, 0, 2]), 3)) == [3, 0, 2, 0, 2]
    before, after = suffix_dedup.smaller_neighbours(np.array([3, 5, 4, 1, 2]))
    assert list(before) == [-1, 0, 0, -1, 3] and list(after) == [3, 2, 3, 5, 5]

    rnd = np.random.default_rng(7)
    for size, length in ((300, 20), (1, 8), (0, 8), (200, 100)):
        ctx = rnd.integers(0, 2, (size, length)).astype(np.uint8)
        ctx[rnd.integers(0, max(size, 1), size // 2)] = ctx[:1]
        group, position = rnd.integers(0, 3, size), rnd.permutation(size)

        def lcp(i, j):
            return int(np.argmax(np.append(ctx[i] != ctx[j], True)))

        want = [max([lcp(i, j) for j in range(size) if group[i] == group[j] and position[j] < position[i]], default=0)
                for i in range(size)]
        assert list(suffix_dedup.longest_previous_factor(group, suffix_dedup.as_words(ctx), position, length)) == want


# --- 7 language ID ------------------------------------------------------------------------------

def test_langid(spark):
    en, de = "the quick thing over that with which there ", "der und nicht eine schön über auch werden "
    rows = [(i, (en if i % 2 else de) * (1 + i % 4)) for i in range(120)] + [(500, None), (501, ""), (502, "123 !!"), (None, en), (17, en * 500)]
    d = spark.createDataFrame([(i, t, None if i is None or i >= 500 else "en" if i % 2 else "de", "s") for i, t in rows],
                              "doc_id long, text string, lang string, source string")
    out = kernel_langid.identify(d).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (500, 501, 502):
            assert r.lang_pred == "und"
        elif r.doc_id is not None:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
    assert kernel_langid.identify(d.limit(0)).count() == 0
    assert {r.lang_pred for r in kernel_langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_accuracy_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    out = [r for r in kernel_langid.identify(d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97


def test_langid_kernel_matches_sets():
    a, b = "hello wörld", "hellö"
    x = kernel_langid.presence([a, b])
    sets = [set(kernel_langid.grams(t)) for t in (a, b)]
    want = len(sets[0] & sets[1]) / math.sqrt(len(sets[0]) * len(sets[1]))
    assert abs(kernel_langid.kernel(x, x)[0, 1] - want) < 1e-6


# --- 8 secrets ----------------------------------------------------------------------------------

def brute_secrets(t):
    import re
    t = t or ""
    low = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    both = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "(password|passwd|secret|token|api_?key)") + low[low.index(")") + 1:]
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(both, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def secret_rows():
    import random
    rnd = random.Random(5)
    hexs = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = X.texts() + [(600 + i, f"say {key()} or password={hexs(16)} and {hexs(40)} done") for i in range(60)]
    return rows + [(700, "plain " + hexs(20) + " here"), (701, "TOKEN : secret=abcdef"), (702, "secret:token :abcdef"),
                   (703, "thonheredbleing2 wordwordwordwordword"), (704, key() * 3), (705, "é" + key() + "ü")]


def test_secrets(spark):
    rows = secret_rows()
    got = {}
    for r in grammar_secrets.scan(X.docs(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        if i is None:
            continue
        base = brute_secrets(t)
        n = Counter(k for *_, k in base)
        written = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"]), t
        assert got[i].base_sha256 == sha(written)
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("format")] == [x for x in written.split(",") if x]
    assert "format:6:26" in got[700].spans and "format" not in got[703].spans
    assert grammar_secrets.scan(X.docs(spark, [])).count() == 0


def test_secrets_rare_kind_is_learned(spark):
    rnd = random.Random(8)
    key = lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    keys = [key() for _ in range(30)]
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2000 == 7, F.concat(F.lit("key "), F.element_at(
        F.array(*map(F.lit, keys)), (F.col("id") / 2000).cast("int") + 1))).otherwise(F.lit("plain text")).alias("text"))
    assert len(grammar_secrets.fit(d)) == 1
    # what a fit on all rows gives, and no more than PER_KIND of a kind
    many = [(i, f"AKIA{i:016d}") for i in range(1500)]
    want = grammar_secrets.infer([("access", t) for _, t in many])
    got = grammar_secrets.fit(spark.createDataFrame(many, "doc_id long, text string"))
    assert [(a.n, a.next, least) for a, least in got] == [(a.n, a.next, least) for a, least in want]


def test_automaton():
    a = grammar_secrets.Automaton(["AKIA" + "Q7" * 8] * 30 + ["AKIA" + "7Q" * 8] * 30)
    assert a.states < 40 and a.score("AKIA" + "Q7" * 8) > 0 and a.score("hello") == -math.inf


# --- 9 Jaccard join -----------------------------------------------------------------------------

def shingles(t):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", X.lower(t))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    """doc_id -> (shingles, component), for rows with ids."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def join_rows():
    import random
    rnd = random.Random(11)
    rows = list(X.texts())
    vocab = [f"w{i}" for i in range(40)]
    for i in range(160):     # small sets around the boundary, and chains of near copies
        n = rnd.choice([5, 6, 8, 9, 10, 12, 14, 16, 18, 30])
        w = [vocab[(3 * k + n) % 40] for k in range(n)]
        if rnd.random() < .6:
            w[rnd.choice([0, -1, len(w) // 2])] = f"y{rnd.randint(0, 3)}"
        rows.append((1000 + i, " ".join(w + ["tail"] * rnd.randint(0, 2))))
    long = [f"v{i}" for i in range(100)]
    for i in range(12):      # neighbours link, the ends do not
        rows.append((2000 + i, " ".join(long[4 * i:] + [f"n{k}" for k in range(4 * i)])))
    return rows


@pytest.mark.parametrize("light", [0, 6, 12])
def test_jaccard_join(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda h: light)
    rows = join_rows()
    want = brute_join(rows)
    got = jaccard_join.groups(X.docs(spark, rows)).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == sum(i is not None for i, _ in rows)


def test_jaccard_keep_first_and_empty(spark):
    rows = X.texts()
    d = X.docs(spark, rows)
    want = {i for i, (_, c) in brute_join(rows).items() if i == c}
    out = jaccard_join.keep_first(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} - {None} == want
    assert out.where("doc_id = 14").count() == 2 and out.where("doc_id is null").count() == 2
    assert jaccard_join.groups(X.docs(spark, [])).count() == 0


def test_boundary_and_keys():
    assert jaccard_join.choose_boundary({}) == 0 and jaccard_join.choose_boundary({3: 10 ** 6}) >= 3
    for s in range(1, 13):
        for t in range(s, 13):
            if 100 * s >= 80 * t:
                assert jaccard_join.needed(t) in jaccard_join.subset_sizes(s) and jaccard_join.needed(t) in jaccard_join.subset_sizes(t)


# --- 10 decontamination -------------------------------------------------------------------------

def brute_hits(t, items):
    ws = X.words(t)
    hit, ids = set(), set()
    for i, body in items:
        iw = X.words(body)
        if not iw:
            continue
        n = min(13, len(iw))
        wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k:k + n]) in wins:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(ws), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(ws)


def test_decontamination(spark):
    items = [x for x in X.ITEMS if x[0] is not None] + [(7, "of"), (8, "of of of of"), (9, " ".join(f"item{i}" for i in range(13)))]
    rows = X.texts() + [(800, " ".join(f"item{i}" for i in range(4, 19))), (801, " ".join(f"item{i}" for i in range(12)))]
    got = decontaminate.scan(X.docs(spark, rows), X.bench(spark, items))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == \
        X.repeat_rows([(i, *brute_hits(t, items)) for i, t in rows])
    assert decontaminate.scan(X.docs(spark, []), X.bench(spark)).count() == 0
    clean = decontaminate.scan(X.docs(spark, rows), X.bench(spark, [])).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_hit for r in clean)


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [x for x in X.ITEMS if x[0] is not None]
    got = decontaminate.scan(X.docs(spark), X.bench(spark, items))
    assert rows_of(got, "doc_id", "n_hit", "n_items") == X.repeat_rows([(i, *brute_hits(t, items)[1:3]) for i, t in X.texts()])


def test_decontamination_of_repeated_rows(spark):
    items = [x for x in X.ITEMS if x[0] is not None]
    whole = "before " + X.ITEMS[0][1] + " after"
    rows = X.texts() + [(810, whole)] * 2 + [(811, "short item words")] * 3 + [(None, whole)] * 2 + [(812, whole), (813, whole)]
    got = decontaminate.scan(X.docs(spark, rows), X.bench(spark, items))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == \
        X.repeat_rows([(i, *brute_hits(t, items)) for i, t in rows])
