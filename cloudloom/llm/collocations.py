"""Phrase collocations by top-order marginalisation.

Each word position opens one window: the word and, in lead columns, the two after it, padded where the piece ends. Only
these longest windows are counted; Spark's ROLLUP then sums them to the counts of their prefixes, which are all
shorter phrases.

1. tasks count their windows, as 64-bit word hashes, before anything moves, and send sorted, numbered counts to buckets
   by language and first two words. A few first pairs so frequent that one bucket could not hold them go by all
   three words;
2. a bucket adds up its windows. What no candidate can hold loses its last column there: a window that comes too seldom,
   then a pair that does. No sum of a phrase that matters changes;
3. ROLLUP over what is left; cuts, scores and the longer phrases that hide shorter ones are joins of its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.tables import bucket_count, joined, lean, lean_group, thin
from cloudloom.llm.words import mix, slices, split_words
from cloudloom.session import cut_lineage

MIN_COUNT, TOP, COVER = 10, 2000, 50
FLUSH, MERGE = 1 << 19, 1 << 17  # windows counted at once in a task, and in a bucket
BUCKET_BYTES = 8 << 20  # text behind one bucket
SAMPLE, HOT_KEEP, HOT_SHARE = 2000, 1024, 1000  # texts that pick hot pairs, pairs kept, one window in so many makes a pair hot
NO_LANG = "und"
_PIECES = np.arange(256, dtype=np.uint8)
_PIECES[[ord(c) for c in ".,;:!?"]] = 0x0A  # what ends a piece
_PIECES[ord("A") : ord("Z") + 1] += 32
_ONE = np.uint64(1)


def windows_of(column: pa.Array):
    """(row, codes, strings, leads) of runs of texts: `row` of every word, its code, a function that gives the words at
    some places, and the codes of the one and the two words after it, 0 beyond the piece."""
    for row, data, offsets in slices(column):
        words = split_words(_PIECES[data], offsets)
        code = np.maximum(words.code, _ONE)
        ends = np.concatenate([[0], np.cumsum((words.data >= 0x0A) & (words.data <= 0x0D))])
        n = len(code)
        near = np.zeros(n, bool)  # the next word lies in the same piece
        if n > 1:
            near[:-1] = ends[words.start[1:]] == ends[words.end[:-1]]
            near[words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < n)] - 1] = False
        second, third = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        second[:-1] = np.where(near[:-1], code[1:], 0)
        third[:-2] = np.where(near[:-2] & near[1:-1], code[2:], 0)

        def strings(at, words=words):
            raw = words.data.tobytes()
            return [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]

        yield row + words.text_of(), code, strings, (second, third)


def count_rows(columns: list[np.ndarray], weight: np.ndarray | None = None):
    """Distinct rows of up to three columns of codes in order, the sum of their weights, all codes and the rows as numbers of them."""
    names, number = np.unique(np.concatenate(columns), return_inverse=True)
    number = number.reshape(len(columns), -1)
    if len(names) < 1 << 21:
        key = number[0]
        for c in number[1:]:
            key = key << 21 | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    else:
        order = np.lexsort(number[::-1])
        moved = number[:, order]
        new = np.concatenate([[True], (moved[:, 1:] != moved[:, :-1]).any(0)])
    at = np.flatnonzero(new)
    weight = np.ones(len(order), np.int64) if weight is None else weight[order]
    sums = np.add.reduceat(weight, at) if len(at) else weight[:0]
    return number[:, order[at]], sums, names


def lang_code(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def pair_code(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first ^ lang_code(lang)) + second)


def _bucket(lang, first, second, third, hot, n_buckets):
    pair = pair_code(lang, first, second)
    if len(hot):
        pair = np.where(np.isin(pair, hot), mix(pair + third), pair)
    return (pair % np.uint64(n_buckets)).astype(np.int64)


def pack_counts(number: np.ndarray, sums: np.ndarray, names: np.ndarray) -> bytes:
    """Sorted windows as small numbers of their words, column by column: neighbours repeat, and compress well."""
    used, small = np.unique(number, return_inverse=True)
    width = np.uint16 if len(used) <= 1 << 16 else np.uint32
    head = np.array([len(used), len(sums), np.dtype(width).itemsize], np.int64)
    return b"".join([head.tobytes(), names[used].tobytes(), small.reshape(3, -1).astype(width).tobytes(), sums.astype(np.int64).tobytes()])


def unpack_counts(data) -> tuple[np.ndarray, np.ndarray]:
    n_names, n, width = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + 8 * n_names
    names = np.frombuffer(data, np.uint64, n_names, 24)
    small = np.frombuffer(data, {2: np.uint16, 4: np.uint32}[width], 3 * n, at)
    return names[small].reshape(3, n), np.frombuffer(data, np.int64, n, at + 3 * n * width)


def pack_words(codes: np.ndarray, words: list[bytes]) -> bytes:
    size = np.array([len(w) for w in words], np.uint32)
    return b"".join([np.array([len(codes)], np.int64).tobytes(), codes.tobytes(), size.tobytes(), *words])


def unpack_words(data) -> tuple[np.ndarray, list[bytes]]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    memory = memoryview(data)
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 8 + 8 * n).astype(np.int64)) + 8 + 12 * n
    return np.frombuffer(data, np.uint64, n, 8), [bytes(memory[a:b]) for a, b in zip([8 + 12 * n, *ends[:-1].tolist()], ends.tolist())]


def hot_pairs(texts: DataFrame) -> np.ndarray:
    """Codes of the first pairs with more than one in HOT_SHARE of all windows, judged by a bounded sample of texts. They
    only tell where windows are added up."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, code, _, (second, _) in windows_of(batch.column("_text")):
                for lang in set(langs[row]):
                    mine = langs[row] == lang
                    pair, n = np.unique(pair_code(lang, code[mine], second[mine]), return_counts=True)
                    often = n > mine.sum() // (4 * HOT_SHARE)
                    pair, n = np.append(pair[often].view(np.int64), 0), np.append(n[often], len(row) if lang == langs[row][0] else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    picked = thin(texts, F.xxhash64("_text"), SAMPLE, margin=1)
    counted = picked.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n")).limit(HOT_KEEP + 1).collect()
    total = max((r["n"] for r in most if r["pair"] == 0), default=0)
    return np.array([r["pair"] for r in most if r["pair"] and r["n"] * HOT_SHARE > total], np.int64).view(np.uint64)


def _send(hot: np.ndarray, n_buckets: int):
    """Counts of windows, and the words behind the codes, of a task for the buckets."""

    def flush(held, words):
        out = []
        for lang, parts in held.items():
            number, sums, names = count_rows([joined([p[k] for p in parts], np.uint64) for k in range(3)])
            bucket = _bucket(lang, *names[number], hot, n_buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            for a, b in zip(bounds[:-1], bounds[1:]):
                these = order[a:b]
                out.append((int(bucket[these[0]]), lang, pack_counts(number[:, these], sums[these], names)))
        codes = np.fromiter(words, np.uint64, len(words))
        texts = list(words.values())
        bucket = (mix(codes) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            these = order[a:b]
            out.append((int(bucket[these[0]]), None, pack_words(codes[these], [texts[i] for i in these.tolist()])))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())],
            ["bucket", "lang", "data"],
        )

    def fn(batches):
        held, words, n, told = {}, {}, 0, set()
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, code, strings, (second, third) in windows_of(batch.column("_text")):
                if not len(code):
                    continue
                fresh, at = np.unique(code, return_index=True)
                new = [k for k, c in enumerate(fresh.tolist()) if c not in told]
                told.update(fresh[new].tolist())
                words.update(zip(fresh[new].tolist(), strings(at[new])))
                mine = langs[row]
                for lang in set(mine):
                    at = np.flatnonzero(mine == lang)
                    held.setdefault(lang, []).append((code[at], second[at], third[at]))
                n += len(code)
                if n >= FLUSH:
                    yield flush(held, words)
                    held, words, n = {}, {}, 0
                    if len(told) > FLUSH // 4:  # a word told twice does no harm
                        told.clear()
        yield flush(held, words)

    return fn


_TOPS = "lang string, w1 long, w2 long, w3 long, n long, word string"


def _merge(hot: np.ndarray, min_count: int):
    """Whole windows of a bucket, without the columns that no candidate needs; and its words."""

    def shorten(lang, data, share, shares):
        """Windows of a share of the pairs, added up, with their last columns dropped where they come too seldom."""
        parts = []
        for d in data:
            codes, n = unpack_counts(d)
            if shares > 1:
                mine = (pair_code(lang, codes[0], codes[1]) >> np.uint64(40)) % np.uint64(shares) == share
                codes, n = codes[:, mine], n[mine]
            parts.append((codes, n))
        number, sums, names = count_rows(list(np.concatenate([p[0] for p in parts], 1)), np.concatenate([p[1] for p in parts]))
        first, second, third = names[number]
        third[sums < min_count] = 0
        begins = np.flatnonzero(np.concatenate([[True], (number[0][1:] != number[0][:-1]) | (number[1][1:] != number[1][:-1])])[: len(sums)])
        if len(sums):
            of_pair = np.repeat(np.add.reduceat(sums, begins), np.diff(np.append(begins, len(sums))))
            seldom = of_pair < min_count
            if len(hot):
                seldom &= ~np.isin(pair_code(lang, first, second), hot)
            second[seldom] = 0
            third[seldom] = 0
        number, sums, names = count_rows([first, second, third], sums)
        return (*names[number], sums)

    def fn(table: pa.Table) -> pa.Table:
        out, words, by_lang = [], {}, {}
        for lang, data in zip(table["lang"].to_pylist(), (d.as_buffer() for d in table["data"])):  # read in place
            if lang is None:
                words.update(zip(*(x if isinstance(x, list) else x.tolist() for x in unpack_words(data))))
            else:
                by_lang.setdefault(lang, []).append(data)
        for lang in sorted(by_lang):
            data = by_lang.pop(lang)
            shares = 1 + sum(int(np.frombuffer(d, np.int64, 2)[1]) for d in data) // MERGE
            kept = [shorten(lang, data, share, shares) for share in range(shares)]
            number, sums, names = count_rows([np.concatenate([k[i] for k in kept]) for i in range(3)], np.concatenate([k[3] for k in kept]))
            out.append((lang, *names[number].view(np.int64), sums))
        codes = np.fromiter(words, np.uint64, len(words)).view(np.int64)
        none, size = np.zeros(len(codes), np.int64), [len(o[4]) for o in out]
        text = pa.array([w.decode("utf-8", "replace") for w in words.values()], pa.string())
        return pa.table(
            {
                "lang": pa.concat_arrays([*[pa.array([o[0]] * len(o[4]), pa.string()) for o in out], pa.nulls(len(codes), pa.string())]),
                "w1": np.concatenate([*[o[1] for o in out], codes]),
                "w2": np.concatenate([*[o[2] for o in out], none]),
                "w3": np.concatenate([*[o[3] for o in out], none]),
                "n": np.concatenate([*[o[4] for o in out], none]),
                "word": pa.concat_arrays([pa.nulls(sum(size), pa.string()), text]),
            }
        )

    return fn


def phrase_counts(texts: DataFrame, n_buckets: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f, level): occurrences of every phrase that comes `min_count` times, unused columns 0, and at
    level 0 of all words of a language; and (code, word)."""
    hot = hot_pairs(texts)
    sent = texts.mapInArrow(lean(_send(hot, n_buckets)), "bucket int, lang string, data binary")
    tops = cut_lineage(sent.groupBy("bucket").applyInArrow(lean_group(_merge(hot, min_count)), _TOPS))
    words = tops.filter("word IS NOT NULL").select(F.col("w1").alias("code"), "word")
    # buckets of one task meet here first, so that the rollup sees each window once
    whole = tops.filter("word IS NULL").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
    sums = whole.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).when(F.col("gid") == 3, 1).when(F.col("gid") == 7, 0)
    last = F.when(F.col("gid") == 0, F.col("w3")).when(F.col("gid") == 1, F.col("w2")).otherwise(F.lit(1))
    kept = sums.withColumn("level", level).filter(F.col("level").isNotNull() & (last != 0) & ((F.col("level") == 0) | (F.col("f") >= min_count)))
    return cut_lineage(kept.select("lang", "w1", "w2", "w3", F.col("f").cast("long").alias("f"), "level")), words


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimal arithmetic, exact below 10^16."""
    big = lambda c: c.cast("decimal(18,0)")
    over = F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a))
    return F.call_function("div", over, big(left) * big(right)).cast("long")


def mine_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER
) -> DataFrame:
    """The `top` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; `.,;:!?` and line ends cut texts into pieces, blanks and tabs pieces into words. n: words of the
    language (null: `und`). a: occurrences of the phrase, at least `min_count`. l, r: occurrences of the two parts at the
    cut with the smallest score floor(1000000 a a / (l r)), the first of equal ones. A phrase goes if a longer one that
    holds it has at least `cover` per cent of its occurrences. Order: score and a, both descending, then phrase. Null and empty
    texts have no words; repeated rows count repeatedly; no rows give no rows; other columns are ignored. Words are
    compared by 64-bit hashes.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("_text"))
    counts, words = phrase_counts(texts, bucket_count(docs, text_col, BUCKET_BYTES), min_count)
    one = counts.filter("level = 1")
    total = counts.filter("level = 0").select("lang", F.col("f").alias("n"))
    two = counts.filter("level = 2").select("lang", "w1", "w2", F.col("f").alias("a"))
    two = two.join(one.select("lang", "w1", F.col("f").alias("l")), ["lang", "w1"])
    two = cut_lineage(two.join(one.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r")), ["lang", "w2"]))
    three = counts.filter("level = 3").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    head = two.select("lang", "w1", "w2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    three = three.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    three = three.withColumns({"s1": score_of(F.col("a"), F.col("f1"), F.col("f23")), "s2": score_of(F.col("a"), F.col("f12"), F.col("f3"))})
    late = F.col("s2") < F.col("s1")
    three = cut_lineage(
        three.select(
            "lang", "w1", "w2", "w3", "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
            F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"),
        )
    )
    inside = three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a"))
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("most"))
    two = two.join(inside, ["lang", "w1", "w2"], "left").filter(f"most IS NULL OR 100 * most < {int(cover)} * a")
    two = two.select("lang", "w1", "w2", F.lit(0).cast("long").alias("w3"), "a", "l", "r", score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    found = two.unionByName(three)

    # spelling is needed for the order of equal ones: of those that may be among the first
    by_number = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = cut_lineage(found.withColumn("_rank", F.rank().over(by_number)).filter(F.col("_rank") <= top).drop("_rank"))
    needed = found.select(F.explode(F.array("w1", "w2", "w3")).alias("code")).filter("code <> 0").distinct()
    spelled = cut_lineage(words.join(needed, "code").groupBy("code").agg(F.min("word").alias("word")))
    for k in (1, 2, 3):
        found = found.join(spelled.select(F.col("code").alias(f"w{k}"), F.col("word").alias(f"_{k}")), f"w{k}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "_1", "_2", "_3"))
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(in_order).cast("long")).filter(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
