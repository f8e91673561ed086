"""Source mixing, phrase collocations and hard negatives against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LOWER, words

from check_oracle import compare, connect
from cloudloom.llm import collocations, hard_negatives
from cloudloom.llm.collocations import mine_collocations
from cloudloom.llm.hard_negatives import mine_hard_negatives, references, score_bounds
from cloudloom.llm.mixing import mix_sources, mixture, source_targets
from cloudloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_mixing", "op12_collocations", "op13_hard_negatives"])
def test_twins(spark, name):
    why, _ = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert why is None, why


# --- mixing ---------------------------------------------------------------------------------
def shares(sizes, weights, most):
    """Targets by sharing out again until nobody is above the limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return target


def mix_rows(n=400):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "ß", "z", "hot", "hot", "hot", None])) for i in range(n)]
    long = [(n, "x " * 50_000, "hot"), (None, None, "a"), (None, "no id", "a"), (7, "again id", None), (7, "again id", None), (n + 1, " \t", "none here"), (n + 2, None, "none here")]
    return [(i, t, s, "k", "y") for i, t, s in [*rows, *long]]


MIX = "doc_id long, text string, source string, size string, _key string"


@pytest.mark.parametrize("part_rows", [50, 1 << 20])
def test_mixing(spark, part_rows):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, MIX).repartition(5)
    got = mix_sources(docs, part_rows=part_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3), part_rows=part_rows).collect()))  # reruns agree
    assert len(got) == len(rows) and all(r["_key"] == "y" and r["size"] == len(words(r["text"])) for r in got)
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(words(t))
    target, taken = shares(sizes, (1, 2, 3), 3), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-9)
        whole = math.floor(r["target"] + 0.5) // max(1, r["source_size"])
        assert whole * r["size"] <= r["taken"] <= min(3, whole + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(target[s] + 0.5) for s in sizes)
    assert taken["none here"] == 0 and math.isclose(sum(target.values()), sum(sizes.values()))


def test_mix_order_and_texts(spark):
    rows = [(i, f"a{i} b{i} c{i}", "s" if i % 3 else "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, weights=(1, 9), seed=5)
    got = {r["doc_id"]: r for r in mixed.collect()}
    key = lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest()[:16]
    for source in "st":
        ids = sorted((i for i in got if got[i]["source"] == source), key=key)
        extra = [got[i]["taken"] - 3 * (math.floor(got[i]["target"] + 0.5) // got[i]["source_size"]) for i in ids]
        assert extra == sorted(extra, reverse=True) and sum(0 < e < 3 for e in extra) <= 1
    drawn = mixture(mixed).collect()
    assert sum(r["words"] for r in drawn) == sum(r["taken"] for r in got.values())
    assert all(len(words(r["text"])) == r["words"] and got[r["doc_id"]]["text"].startswith(r["text"]) for r in drawn)
    assert max(r["epoch"] for r in drawn) <= 2


def test_targets_of_many_sources(spark):
    rng = random.Random(1)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 1000, 100_000]) for i in range(200)} | {None: 12}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shares(sizes, (1, 2, 3), 3)
    for r in source_targets(df, "source").collect():
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], MIX)
    assert mix_sources(empty).collect() == []
    none = spark.createDataFrame([(1, None, None, "", ""), (2, "", "a", "", "")], MIX)
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(none).collect()] == [(0, 0.0, 0)] * 2


# --- collocations ---------------------------------------------------------------------------
def collocate(rows, least, top, cover):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    found = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[p[:1] + p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
            s, k = min(cuts)
            found[p] = (a, f[p[: k + 1]], f[p[:1] + p[k + 1 :]], s)
    longer = [p for p in found if len(p) == 4]
    hidden = {p[:1] + q for p in longer for q in (p[1:3], p[2:4]) if 100 * found[p][0] >= cover * found[p[:1] + q][0]}
    out = []
    for lang in n:
        mine = sorted((-v[3], -v[0], " ".join(p[1:]).encode(), v) for p, v in found.items() if p[0] == lang and p not in hidden)
        out += [(lang, i, p.decode(), *v[:3], n[lang], v[3]) for i, (_, _, p, v) in enumerate(mine[:top], 1)]
    return sorted(out)


def talk(n=500):
    rng = random.Random(8)
    vocabulary = ["new", "York", "city", "the", "The", "of", "ça", "日本", "x\x00y", "e\x1fé", "~"]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\x0b", ";:"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w += ["Hot", "pair", f"u{rng.randrange(200)}"] * 3
        rows.append((rng.choice([" ", "  ", "\t"]).join(w), rng.choice(["en", "en", "en", None, "de", ""])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "xx"), ("one two one two " * 20_000, "de"), *[("again and again. and again", "fr")] * 30]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many flushes, many buckets, hot pairs
        for name, value in (("FLUSH", 500), ("BUCKET_BYTES", 5000), ("HOT_SHARE", 50)):
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(collocations.bucket_count, "__defaults__", (5000,))
    rows = talk()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, w1 string").repartition(6)
    got = sorted(map(tuple, mine_collocations(docs, min_count=3, top=40).collect()))
    assert got == collocate(rows, 3, 40, 50)


def test_hot_pairs_change_nothing(spark):
    texts = spark.createDataFrame([("en", t) for t, _ in talk(200)], "lang string, _text string")
    hot = collocations.hot_pairs(texts)
    assert len(hot) > 0  # one pair opens a tenth of all windows
    few, none = (sorted(map(tuple, mine_collocations(texts, "_text", min_count=m).collect())) for m in (2, 10**9))
    assert none == [] and few == collocate([(t, "en") for t, _ in talk(200)], 2, 2000, 50)


def test_no_collocations(spark):
    assert mine_collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_are_exact(spark):
    a, left, right = 10**15 + 7, 10**15 + 11, 10**15 + 9
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 3 * 10**12, 10)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * x * x // (y * z) for x, y, z in [(a, left, right), (10, 10, 10), (10, 3 * 10**12, 10)]]


# --- hard negatives -------------------------------------------------------------------------
def negatives_of(rows, every, k, m):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(object), g) for i, v, g in rows if v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in ok), default=0)
    ok = [(i, np.concatenate([v, np.zeros(dim - len(v), object)]), g) for i, v, g in ok]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, v, g) in enumerate(ok):
        if i is None or i % every:
            continue
        scores = sorted(((-int(sum(v * w)), last(j), j, h) for q, (j, w, h) in enumerate(ok) if q != n), key=lambda s: s[:2])
        for s, _, p, _ in [s for s in scores if s[3] == g][:k]:
            fits = [t for t in scores if t[3] != g and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(i, p, r, t[2], -s, -t[0]) for r, t in enumerate(fits[:m], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, id long, part string"


def vector_rows(n=700, dim=6, copies=150):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        g = int(rng.integers(0, 4))
        v = (centers[g] + rng.normal(size=dim) * 0.5) * rng.choice([0.1, 1, 3])
        rows.append((i, [float(np.float32(x)) for x in v], g))
    rows += [(n + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 1) for i in range(copies)]  # copies of one vector
    odd = [(2000, None, 1), (2010, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2020, [float("nan")] * 6, 2), (2030, [float("inf")] * 6, 2), (2040, [1.0] * 6, None),
           (2050, [0.0] * 6, 3), (2060, [], 0), (2070, [1.0, 2.0], 0), (None, [1.0] * 6, 1), (None, [2.0] * 6, 2), (50, [0.5] * 6, 2), (50, [0.5] * 6, 2)]
    return rows + odd


@pytest.mark.parametrize("part_rows", [40, None])
def test_hard_negatives(spark, part_rows, monkeypatch):
    if part_rows:
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 20)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, part_rows=part_rows)
    assert sorted(map(tuple, got.collect()), key=str) == negatives_of(rows, 10, 5, 10)


def test_labels_of_text_and_wide_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**18), 2**18, size=4)], "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = mine_hard_negatives(df, F.col("vec_id") % 5 == 0, part_rows=16)
    assert sorted(map(tuple, got.collect()), key=str) == negatives_of(rows, 5, 5, 10)
    with pytest.raises(ValueError):
        mine_hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda x: x * 2.0**20)), F.lit(True))


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, 1, "")], [(1, [1.0], 1, 1, "")]):
        assert mine_hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, [1.0], 1, 1, "")], VECTORS)
    assert mine_hard_negatives(alone, F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 8)) * rng.choice([1, 50, 1000], size=(300, 1))
    rows[:20] = rows[20] * rng.uniform(0.5, 2, size=(20, 1))  # along one line
    refs = references(rows)
    norm = np.sqrt((rows**2).sum(1))
    angle = hard_negatives.angles_to(rows, norm, refs)
    blocks = np.array_split(np.argsort(angle[:, 0]), 30)
    ends = lambda f, x: np.array([f(x[b], axis=0) for b in blocks])
    low, top = score_bounds(norm, angle, ends(np.min, norm), ends(np.max, norm), ends(np.min, angle), ends(np.max, angle))
    score = rows @ rows.T
    for j, b in enumerate(blocks):
        assert (low[:, j] <= score[:, b].min(1)).all() and (score[:, b].max(1) <= top[:, j]).all()
    assert (top < score.max()).mean() > 0.5  # and they tell something
