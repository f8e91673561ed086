"""Registered queries and the pipeline against brute force and DuckDB, on the smallest tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_operators import LOWER, RULES, jaccard_groups, words

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, connect
from cloudloom.llm.language_id import Compressors, fit_dictionaries

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name):
    return {r[0]: r for r in queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_suffix_dedup", "op4_ngram_jaccard_join", "op10_substring_dedup"])
def test_twins(spark, duck, name):
    why, _ = compare(queries()[name](spark, SF), duck, oracle_sql()[name])
    assert why is None, why


def leak(item, text, similarity=0.8):
    """True if a run of words of `text` lies within the allowed edits of `item`."""
    split = lambda t: re.sub(r"[^0-9A-Za-z\x80-\U0010ffff]+", " ", t.translate(LOWER)).split(" ")
    a, b = ([w for w in split(t) if w] for t in (item, text))
    names = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    b = np.array([names[w] for w in b], np.int64)
    row, slope = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for w in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != names[w]))
        row = np.minimum.accumulate(new - slope) + slope
    return row.min() <= (1 - similarity) * len(a) + 1e-9


def test_decontamination(spark, duck, documents):
    bench = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    for key, r in rows(spark, "op2_decontamination").items():
        expected = [i for i, t in sorted(bench) if leak(t, documents[key])]
        assert r["item_ids"] == ",".join(map(str, expected)) and r["contaminated"] == bool(expected)


def test_language(spark, duck, documents):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(spark, "op5_language_id")
    assert set(got) == set(documents)
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(held)) and 0 <= got[k]["score"] <= 1 for k in got)
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.9 * len(held)


def test_tokens(spark, documents):
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    for key, r in rows(spark, "op6_sentencepiece").items():
        ids = lib.encode(documents[key] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_secrets(spark, documents):
    patterns = (
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", r"(AKIA[A-Z0-9]+)", 16),
        ("hex", r"([0-9a-f]+)", 32),
    )
    for key, r in rows(spark, "op7_secret_scan").items():
        spans, counts = [], {}
        for k, (kind, pattern, least) in enumerate(patterns):
            found = [m.span() for m in re.finditer(pattern, documents[key] or "") if len(m[1]) >= least]
            counts[kind] = len(found)
            spans += [(a, k, b, kind) for a, b in found]
        assert all(r[f"n_{k}"] == n for k, n in counts.items())
        base = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(",")) | {""}


def test_scores(spark, documents):
    texts = {k: [w.translate(LOWER) for w in words(t)] + ["\n"] for k, t in documents.items()}
    count = collections.Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in t)
    total, kinds = sum(count.values()), len(count)
    got = rows(spark, "op8_lm_score")
    for key, r in got.items():
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in texts[key])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_known"] == sum(count[w] > 0 for w in texts[key])
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(texts[key]), total, zlib.crc32(str(key).encode()) % 5 == 1)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the recurrent model tells more than counts


def test_urls(spark, duck):
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    got = rows(spark, "op9_url_filter")
    assert set(got) == set(urls)
    for key, r in got.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[key] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [
            (len(rule), verdict, rule) for verdict, rule in RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])
        ]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[2] if fits else None)
        assert r["verdict"] == (max(fits)[1] if fits else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_pipeline(spark, duck, documents):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    judge = Compressors(fit_dictionaries(table)).judge
    left = {k: t for k, t in documents.items() if judge(t)[0] != "und" and judge(t)[1] >= corpus_pipeline.MIN_MARGIN}
    first = {}
    for k in sorted(left):
        first.setdefault(left[k].translate(LOWER), k)
    left = {k: left[k] for k in first.values()}
    left = {k: left[k] for k, _, root in jaccard_groups(sorted(left.items())) if k == root}
    bench = [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    left = {k: t for k, t in left.items() if not any(leak(b, t) for b in bench)}
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    expected = {k: (" ".join(map(str, lib.encode(t, add_eos=True))), sha(t)) for k, t in left.items()}
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in queries()["pipeline"](spark, SF).collect()}
    assert got == expected and len(got) > 0.5 * len(documents)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate([None, "", "12 34", "x"])], docs.schema)
    docs = docs.limit(40).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_drops_narrow_leads(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judge = Compressors(fit_dictionaries(docs)).judge
    en, de = (" ".join(r.text for r in docs.filter(f"lang = '{lang}'").orderBy("doc_id").limit(20).collect())[:3000] for lang in ("en", "de"))
    mixes = [en[:a] + " " + de[:b] for a in (400, 1200, 2000) for b in range(60, 600, 4)]
    narrow = {t for t in mixes if 1e-9 < judge(t)[1] < 0.005}
    assert narrow
    mixed = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(sorted(narrow)[:5])], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(mixed), SF)
    assert kept.filter(f"doc_id >= {10**6}").count() == 0 and kept.count() > 0
