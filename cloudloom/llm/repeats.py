"""Words covered by passages that occur more than once: the machinery behind substring and suffix-array dedup.

A window is `window` consecutive words of one text. Both operators remove each word covered by a window whose
word sequence also starts anywhere else, and differ in the anchors that find such windows without hashing all:

1. every text gives anchors (`Anchors.pick`: sparse positions, each a hash of `Anchors.size` words), chosen so
   that two equal windows share an anchor at the same offset;
2. anchors meet by hash in buckets, whose number follows the text; those seen once are dropped;
3. texts take their shared anchors back and extend each left and right: every window around a shared anchor is
   hashed whole, and meets its equals by hash;
4. texts take back the windows seen more than once and drop what they cover.

A task counts what repeats within itself first and sends one marked entry for it, so an anchor or window
that a third of all rows share reaches its bucket once per task, not once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tables import bucket_count, joined, pack, row_key, runs, unpack
from cloudloom.llm.words import Words, mix, slices, split_words, window_codes, window_starts

ANCHOR_BYTES = 5  # of an anchor's hash that travel; the bucket adds the rest, and step 3 is exact anyway
WINDOW_BYTES = 8
FLUSH = 1 << 21  # entries that a task gathers before it sends them
ENTRY = "route int, kind int, key binary, code binary"
_ENTRY = pa.schema([("route", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("code", pa.binary())])


@dataclass(frozen=True)
class Anchors:
    """`size`: words of an anchor; `reach`: an anchor lies at most this many words after the start of a window."""

    size: int
    reach: int

    def pick(self, words: Words) -> np.ndarray:
        """Indices of the words at which anchors start, ascending."""
        raise NotImplementedError


def _blobs(route, kind, key, code, code_bytes):
    """Entries as rows of bytes, one row per route."""
    order = np.argsort(route, kind="stable")
    begin, count = runs(route[order])
    out = {"route": [], "kind": [], "key": [], "code": []}
    for b, n in zip(begin, count):
        at = order[b : b + n]
        out["route"].append(int(route[at[0]]))
        out["kind"].append(kind)
        out["key"].append(b"" if key is None else key[at].tobytes())
        out["code"].append(pack(code[at], code_bytes))
    return pa.RecordBatch.from_pydict(out, schema=_ENTRY)


def _home(keys, n_buckets):
    """The group of texts that a row key, read as unsigned, belongs to."""
    return (keys.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)


def _meet(keys, codes, route_of, n_buckets, code_bytes):
    """Rows for the buckets: one entry per code that this task saw once (kind 0, key: where) or more often
    (kind 1), and for the latter also what the texts get back (kind 2, spread over all buckets)."""
    order = np.argsort(codes, kind="stable")
    keys, codes = keys[order], codes[order]
    start, length = runs(codes)
    single = length == 1
    once, often = start[single], start[~single]
    yield _blobs(route_of(codes[once]), 0, keys[once], codes[once], code_bytes)
    yield _blobs(route_of(codes[often]), 1, None, codes[often], code_bytes)
    local = np.repeat(~single, length)
    yield _blobs(_home(keys[local], n_buckets), 2, keys[local], codes[local], code_bytes)


def _found(n_buckets, code_bytes):
    """In a bucket: the entries whose code comes more than once, for the groups of texts they belong to."""

    def fn(table: pa.Table) -> pa.Table:
        cols = {k: [] for k in ("key", "code", "many")}
        back_k, back_c = [], []
        for kind, k, c in zip(*(table[x].to_pylist() for x in ("kind", "key", "code"))):
            c = unpack(c, code_bytes)
            if kind == 2:
                back_k.append(np.frombuffer(k, np.int64))
                back_c.append(c)
                continue
            cols["code"].append(c)
            cols["key"].append(np.frombuffer(k, np.int64) if kind == 0 else np.zeros(len(c), np.int64))
            cols["many"].append(np.full(len(c), kind == 1))
        code, key, many = joined(cols["code"], np.uint64), joined(cols["key"], np.int64), joined(cols["many"], bool)
        order = np.argsort(code, kind="stable")
        code, key, many = code[order], key[order], many[order]
        start, length = runs(code)
        shared = np.repeat(length > 1, length) & ~many
        keys = np.concatenate([key[shared], joined(back_k, np.int64)])
        codes = np.concatenate([code[shared], joined(back_c, np.uint64)])
        return pa.Table.from_batches([_blobs(_home(keys, n_buckets), 0, keys, codes, code_bytes)])

    return fn


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << (8 * width)) - 1)


def _sender(n_buckets: int, code_bytes: int, entries):
    """mapInArrow function: `entries(batch)` yields (keys, codes) of a slice of texts."""
    shift = np.uint64(64 - 24)

    def route(codes):  # by the high bits, which do not travel
        return ((codes >> shift) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)

    def fn(batches):
        keys, codes, n = [], [], 0
        for batch in batches:
            for k, c in entries(batch):
                keys.append(k)
                codes.append(c)
                n += len(k)
                if n >= FLUSH:
                    yield from _meet(joined(keys, np.int64), joined(codes, np.uint64), route, n_buckets, code_bytes)
                    keys, codes, n = [], [], 0
        if n:
            yield from _meet(joined(keys, np.int64), joined(codes, np.uint64), route, n_buckets, code_bytes)

    return fn


def _anchor_codes(words: Words, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors start, and their hashes."""
    at = anchors.pick(words)
    codes = window_codes(words.code, anchors.size)
    return at, codes[at] if len(at) else np.zeros(0, np.uint64)


class _Own:
    """Codes that came back to a group of texts, by row key."""

    def __init__(self, table: pa.Table, code_bytes: int):
        key = joined([np.frombuffer(k, np.int64) for k in table["key"].to_pylist()], np.int64)
        code = joined([unpack(c, code_bytes) for c in table["code"].to_pylist()], np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.code = key[order], code[order]

    def of(self, key: int) -> np.ndarray | None:
        a, b = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        return np.unique(self.code[a:b]) if b > a else None


def drop_repeats(docs: DataFrame, anchors: Anchors, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: `id_col`, n_words, n_removed and `kept`, the words that stay joined by one space.

    Null and empty texts give 0, 0 and ''. Equal rows count as separate occurrences and get equal results.
    """
    n_buckets = bucket_count(docs, text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_key"))
    # groups of texts of about a bucket each; both steps below use this one exchange of the texts
    signed = F.pmod(F.col("_key"), F.lit(n_buckets))
    wrap = F.pmod(F.lit((1 << 64) % n_buckets), F.lit(n_buckets))
    home = F.when(F.col("_key") >= 0, signed).otherwise(F.pmod(signed + wrap, F.lit(n_buckets)))  # of the key read as unsigned
    dealt = base.withColumn("_home", home.cast("int"))

    def anchor_entries(batch):
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        for row, data, offsets in slices(batch.column("_text")):
            words = split_words(data, offsets)
            at, codes = _anchor_codes(words, anchors)
            yield keys[row + np.searchsorted(words.first, at, side="right") - 1], codes

    def met(entries: DataFrame, code_bytes: int) -> DataFrame:
        return entries.groupBy("route").applyInArrow(_found(n_buckets, code_bytes), ENTRY)

    def window_entries(texts: pa.Table, own: _Own):
        """Codes of all windows around the shared anchors of each text."""
        keys = texts["_key"].to_numpy()
        for row, data, offsets in slices(texts["_text"]):
            words = split_words(data, offsets)
            at, codes = _anchor_codes(words, anchors)
            edge = np.zeros(len(words.code) + 1, np.int64)
            bounds = np.searchsorted(at, words.first)
            for i in range(len(offsets) - 1):
                shared = own.of(keys[row + i])
                if shared is None:
                    continue
                lo, hi = bounds[i], bounds[i + 1]
                hit = at[lo:hi][np.isin(codes[lo:hi] & _mask(ANCHOR_BYTES), shared)]
                np.add.at(edge, np.maximum(hit - anchors.reach, words.first[i]), 1)
                np.add.at(edge, hit + 1, -1)
            near = np.cumsum(edge[:-1]) > 0
            starts = window_starts(words, window)
            starts = starts[near[starts]]
            if len(starts):
                yield keys[row + np.searchsorted(words.first, starts, side="right") - 1], window_codes(words.code, window)[starts]

    def extend(texts: pa.Table, back: pa.Table) -> pa.Table:
        own = _Own(back, ANCHOR_BYTES)
        entries = lambda _: window_entries(texts, own)
        found = _sender(n_buckets, WINDOW_BYTES, entries)([None]) if len(own.key) and len(texts) else []
        return pa.Table.from_batches(list(found), schema=_ENTRY)

    def finish(texts: pa.Table, back: pa.Table) -> pa.Table:
        own = _Own(back, WINDOW_BYTES)
        keys = texts["_key"].to_numpy() if len(texts) else []
        n_words, n_removed, kept = [], [], []
        for row, data, offsets in slices(texts["_text"]) if len(texts) else ():
            raw = data.tobytes()
            twice = [own.of(keys[row + i]) for i in range(len(offsets) - 1)]
            if any(o is not None for o in twice):
                words = split_words(data, offsets)
                codes = window_codes(words.code, window)
            for i, shared in enumerate(twice):
                stay = parts = raw[offsets[i] : offsets[i + 1]].split()
                if shared is not None:
                    a, b = words.first[i], words.first[i + 1]
                    gone = np.zeros(b - a + 1, np.int64)
                    start = np.flatnonzero(np.isin(codes[a : b - window + 1], shared))
                    gone[start] += 1
                    np.add.at(gone, start + window, -1)
                    stay = [w for w, keep in zip(parts, (np.cumsum(gone[:-1]) == 0).tolist()) if keep]
                n_words.append(len(parts))
                n_removed.append(len(parts) - len(stay))
                kept.append(b" ".join(stay))
        return pa.table(
            [texts["_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["_id", "n_words", "n_removed", "kept"],
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    sent = base.select("_key", "_text").mapInArrow(_sender(n_buckets, ANCHOR_BYTES, anchor_entries), ENTRY)
    shared = met(sent, ANCHOR_BYTES).groupBy("route")
    sent = dealt.groupBy("_home").cogroup(shared).applyInArrow(extend, ENTRY)
    twice = met(sent, WINDOW_BYTES).groupBy("route")
    out = dealt.groupBy("_home").cogroup(twice).applyInArrow(finish, f"_id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", id_col)
