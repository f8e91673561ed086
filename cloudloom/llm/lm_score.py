"""Language-model scores of whole texts: a smoothed word model over all counts, and a recurrent model.

1. words of all training texts are counted, by hash, in buckets that combine before the shuffle;
2. the most frequent words go to every task, as counts and, the first of them, as tokens of the recurrent model. It is
   warmed up on a bounded sample, and then trained on all training texts, dealt by a hash of the row into parts of bounded size;
   the weights of the parts are averaged, so the partitions of the input change nothing;
3. texts are scored where they lie; words beyond the frequent ones ask the buckets for their counts, and the sums
   come home by group of texts.

A word outside the recurrent model's vocabulary counts as its token for other words, times the word's smoothed share among them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.gru import CLASS_SIZE, END, OTHER, Model
from cloudloom.llm.tables import bucket_count, joined, pack, row_key, runs, thin, unpack
from cloudloom.llm.words import mix, slices, split_words
from cloudloom.session import cut_lineage

TOKENS = 30 * CLASS_SIZE  # words of the recurrent model
HEAD = 1 << 16  # words whose counts every task holds
CODE_BYTES = 6  # of a word's hash beyond its bucket
WARM_TEXTS, WARM_CHARS, WARM_PASSES, WARM_RATE = 400, 20_000, 4, 0.01
RATE, PART_STREAMS = 0.002, 256  # of the training on all texts
FLUSH = 1 << 21

_ROWS = pa.schema([("route", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("code", pa.binary()), ("data", pa.binary())])
_SQL = "route int, kind int, key binary, code binary, data binary"
WORDS, TEXT, SUM = range(3)  # kinds of rows
_TEXT = np.dtype([("key", "i8"), ("id", "i8"), ("known_id", "i8"), ("n", "i8"), ("known", "i8"), ("logs", "f8"), ("other", "f8"), ("others", "i8"), ("gru", "f8")])
_SUM = np.dtype([("key", "i8"), ("known", "i8"), ("logs", "f8")])


def _bucket(code, n_buckets):
    """By the high bits, which do not travel."""
    return ((code >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


def _home(key, n_buckets):
    return (mix(key.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _rows(route, kind, key=None, code=None, data=None):
    order = np.argsort(route, kind="stable")
    begin, count = runs(route[order])
    out = {n: [] for n in _ROWS.names}
    for s, n in zip(begin, count):
        at = order[s : s + n]
        out["route"].append(int(route[at[0]]))
        out["kind"].append(kind)
        out["key"].append(None if key is None else key[at].tobytes())
        out["code"].append(None if code is None else pack(code[at], CODE_BYTES))
        out["data"].append(None if data is None else data[at].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_ROWS)


def count_words(train: DataFrame, n_buckets: int) -> DataFrame:
    """Buckets of word counts: route, code (low bytes of sorted hashes), n (counts), words, total."""

    def count(batches):
        def flush(parts):
            code, n = np.unique(joined(parts, np.uint64), return_counts=True)
            return _rows(_bucket(code, n_buckets), WORDS, code=code, key=code, data=n.astype(np.int64))

        parts, held = [], 0
        for batch in batches:
            for _, data, offsets in slices(batch.column("_text")):
                parts.append(split_words(data, offsets, lower=True).code)
                held += len(parts[-1])
            if held >= 2 * FLUSH:
                yield flush(parts)
                parts, held = [], 0
        yield flush(parts)

    def add(table: pa.Table) -> pa.Table:
        code = joined([np.frombuffer(k, np.uint64) for k in table["key"].to_pylist()], np.uint64)
        n = joined([np.frombuffer(d, np.int64) for d in table["data"].to_pylist()], np.int64)
        order = np.argsort(code, kind="stable")
        begin, _ = runs(code[order])
        total = np.add.reduceat(n[order], begin) if len(begin) else n
        code = code[order][begin]
        return pa.table(
            {"route": pa.array([table["route"][0].as_py()], pa.int32()), "code": [code.tobytes()], "n": [total.tobytes()], "words": [len(code)], "total": [int(total.sum())]}
        )

    sent = train.select("_text").mapInArrow(count, _SQL)
    return cut_lineage(sent.groupBy("route").applyInArrow(add, "route int, code binary, n binary, words long, total long"))


@dataclass
class Head:
    """Frequent words by hash: their counts, and their tokens in the recurrent model."""

    code: np.ndarray
    count: np.ndarray
    token: np.ndarray

    def look(self, code):
        """(place, found) of words."""
        if not len(self.code):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return place, self.code[place] == code

    def tokens(self, words) -> list[np.ndarray]:
        place, found = self.look(words.code)
        ids = np.where(found, self.token[place], OTHER) if len(self.code) else np.zeros(len(words.code), np.int64)
        return [np.append(ids[a:b], END).astype(np.int16) for a, b in zip(words.first[:-1], words.first[1:])]


def _head(counts: DataFrame) -> Head:
    def rows(batches):
        for batch in batches:
            for code, n in zip(batch.column("code").to_pylist(), batch.column("n").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(code, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["code", "n"])

    words = counts.select("code", "n").mapInArrow(rows, "code long, n long")
    # the least count that at most HEAD words have, from the number of words of each count
    held, least = 0, None
    for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(HEAD).collect():
        held += r["k"]
        if held > HEAD:
            break
        least = r["n"]
    most = [] if least is None else sorted(words.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["code"]))
    code = np.array([r["code"] for r in most], np.int64).view(np.uint64)
    order = np.argsort(code)
    token = np.zeros(len(code), np.int64)
    token[:TOKENS] = np.arange(2, 2 + min(TOKENS, len(code)))
    return Head(code[order], np.array([r["n"] for r in most], np.int64)[order], token[order])


def _average(weights: DataFrame, fan: int = 32) -> np.ndarray | None:
    """Mean of weight vectors (part, n, w), weighted by n, over a tree of groups of `fan`."""

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # so that sums of floats do not hang on who comes first
        n = table["n"].to_numpy().astype(np.float64)
        w = sum(np.frombuffer(x, np.float32) * k for x, k in zip(table["w"].to_pylist(), n)) / n.sum()
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan], pa.int32()), "n": [int(n.sum())], "w": [w.astype(np.float32).tobytes()]})

    weights = cut_lineage(weights)
    top = weights.agg(F.max("part").alias("m")).first()["m"]
    if top is None:
        return None
    while top > 0:
        weights = cut_lineage(weights.groupBy(F.floor(F.col("part") / fan)).applyInArrow(mean, "part int, n long, w binary"))
        top //= fan
    return np.frombuffer(weights.first()["w"], np.float32)


def fit(train: DataFrame, head: Head, n_parts: int) -> Model:
    """The recurrent model: warmed up on at most WARM_TEXTS texts of at most WARM_CHARS characters, the first by a hash, then trained
    on every training text, in `n_parts` parts."""
    tokens = 2 + int((head.token > 1).sum())
    model = Model(tokens)
    short = train.select("_text", F.xxhash64("_text").alias("h")).filter(F.length("_text").between(1, WARM_CHARS))
    warm = thin(short, F.col("h"), WARM_TEXTS).orderBy(F.pmod("h", F.lit(1 << 40)), "_text").limit(WARM_TEXTS)
    texts = [r["_text"] for r in warm.collect()]

    def ids(column):
        for _, data, offsets in slices(column):
            yield from head.tokens(split_words(data, offsets, lower=True))

    model.train(list(ids(pa.array(texts, pa.string()))), WARM_RATE, WARM_PASSES)
    start = model.flat()

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_key", "ascending"), ("_text", "ascending")]).combine_chunks()
        got = [x for chunk in table["_text"].chunks for x in ids(chunk)]
        done = Model(tokens).load(start).train(got, RATE, streams=PART_STREAMS)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "n": [sum(map(len, got))], "w": [done.flat().tobytes()]})

    dealt = train.select("_key", "_text", F.pmod(F.xxhash64("_key"), F.lit(n_parts)).cast("int").alias("part"))
    mean = _average(dealt.groupBy("part").applyInArrow(learn, "part int, n long, w binary"))
    return model if mean is None else model.load(mean)


def score_texts(docs: DataFrame, is_training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col` (an integer), n_tokens, n_known, train_tokens, base_score, score.

    `is_training` names a boolean column: true for the texts to learn from. Tokens are words, A-Z in lower case, then one end; null and empty texts have the
    end alone. `base_score` adds up log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; `score` is the recurrent model's log10 probability. Without
    training texts N, V and all counts are 0, and the model is untrained. Repeated rows get equal scores. No rows give no rows.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        row_key(id_col, text_col).alias("_key"),
        F.coalesce(F.col(is_training), F.lit(False)).alias("_train"),
    )
    n_buckets = bucket_count(docs, text_col)
    train = base.filter("_train")
    counts = count_words(train, n_buckets)
    ends = train.count()
    row = counts.agg(F.sum("words").alias("v"), F.sum("total").alias("n")).first()
    total, kinds = (row["n"] or 0) + ends, (row["v"] or 0) + (ends > 0)
    head = _head(counts)
    model = fit(train, head, n_buckets)
    inside = head.token > 1
    rest = total - ends - int(head.count[inside].sum())
    rest_log = math.log10(rest + 0.5 * (kinds - (ends > 0) - int(inside.sum()) + 1))  # of the word share among other words
    base_log, weights, tokens = math.log10(total + 0.5 * (kinds + 1)), model.flat(), model.tokens

    def score(batches):
        gru = Model(tokens).load(weights)
        keys, codes, held = [], [], 0
        for batch in batches:
            key = batch.column("_key").to_numpy(zero_copy_only=False)
            ids = batch.column("_id").fill_null(0).to_numpy(zero_copy_only=False)
            known_id = batch.column("_id").is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(key), _TEXT)
            out["key"], out["id"], out["known_id"] = key, ids, known_id
            texts = []
            for r, data, offsets in slices(batch.column("_text")):
                words = split_words(data, offsets, lower=True)
                place, found = head.look(words.code)
                text = words.text_of()
                part = out[r : r + len(offsets) - 1]
                part["n"] = words.counts + 1
                logs = np.where(found, np.log10(head.count[place] + 0.5), 0) if len(head.code) else np.zeros(len(text))
                other = ~(found & (head.token[place] > 1)) if len(head.code) else np.ones(len(text), bool)
                per = lambda w: np.bincount(text, weights=w, minlength=len(part))  # noqa: B023, E731
                part["known"] = per(found) + (ends > 0)
                part["logs"] = per(logs) + math.log10(ends + 0.5)
                part["other"], part["others"] = per(logs * other), per(other)
                texts += head.tokens(words)
                keys.append(key[r + text[~found]])
                codes.append(words.code[~found])
                held += len(codes[-1])
            out["gru"] = gru.score(texts)
            yield _rows(_home(out["key"], n_buckets), TEXT, data=out)
            if held >= FLUSH:
                k, c = joined(keys, np.int64), joined(codes, np.uint64)
                yield _rows(_bucket(c, n_buckets), WORDS, key=k, code=c)
                keys, codes, held = [], [], 0
        if held:
            k, c = joined(keys, np.int64), joined(codes, np.uint64)
            yield _rows(_bucket(c, n_buckets), WORDS, key=k, code=c)

    def look(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        out, keys, codes = [], [], []
        for route, kind, key, code, data in zip(*(asked[c].to_pylist() for c in _ROWS.names)):
            if kind == TEXT:
                out.append(pa.RecordBatch.from_pydict({"route": [route], "kind": [TEXT], "key": [None], "code": [None], "data": [data]}, schema=_ROWS))
            else:
                keys.append(np.frombuffer(key, np.int64))
                codes.append(unpack(code, CODE_BYTES))
        key, code = joined(keys, np.int64), joined(codes, np.uint64)
        if len(key):
            have = joined([np.frombuffer(c, np.uint64) for c in bucket["code"].to_pylist()], np.uint64) & np.uint64((1 << (8 * CODE_BYTES)) - 1)
            n = joined([np.frombuffer(c, np.int64) for c in bucket["n"].to_pylist()], np.int64)
            order = np.argsort(have)
            have, n = np.append(have[order], np.uint64(0)), np.append(n[order], 0)
            place = np.minimum(np.searchsorted(have[:-1], code), len(have) - 1)
            count = np.where(have[place] == code, n[place], 0)
            names, at = np.unique(key, return_inverse=True)
            sums = np.zeros(len(names), _SUM)
            sums["key"] = names
            sums["known"] = np.bincount(at, weights=count > 0)
            sums["logs"] = np.bincount(at, weights=np.log10(count + 0.5))
            out.append(_rows(_home(names, n_buckets), SUM, data=sums))
        return pa.Table.from_batches(out, schema=_ROWS)

    def finish(table: pa.Table) -> pa.Table:
        part = {TEXT: [], SUM: []}
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            part[kind].append(np.frombuffer(data, _TEXT if kind == TEXT else _SUM))
        texts, sums = joined(part[TEXT], _TEXT), joined(part[SUM], _SUM)
        names, at, copies = np.unique(texts["key"], return_inverse=True, return_counts=True)
        known, logs = np.zeros(len(names)), np.zeros(len(names))
        if len(sums):
            order = np.lexsort((sums["logs"], sums["key"]))
            place = np.searchsorted(names, sums["key"][order])
            np.add.at(known, place, sums["known"][order])
            np.add.at(logs, place, sums["logs"][order])
        known, logs = (known / copies)[at], (logs / copies)[at]  # equal rows have asked for the same words
        score = texts["gru"] / math.log(10) + texts["other"] + logs - texts["others"] * rest_log
        return pa.table(
            [
                pa.array(texts["id"].copy(), mask=texts["known_id"] == 0), pa.array(texts["n"].copy()), pa.array((texts["known"] + np.rint(known)).astype(np.int64)),
                pa.array(texts["logs"] + logs - texts["n"] * base_log), pa.array(score),
            ],
            names=["id", "n_tokens", "n_known", "base_score", "score"],
        )

    asked = base.select("_id", "_key", "_text").mapInArrow(score, _SQL)
    found = asked.groupBy("route").cogroup(counts.select("route", "code", "n").groupBy("route")).applyInArrow(look, _SQL)
    done = found.groupBy("route").applyInArrow(finish, "id long, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
