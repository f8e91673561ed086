"""Benchmark decontamination: texts that hold a benchmark item, exactly or with edits.

Words, lower-cased (A-Z) and without punctuation, are the letters here; the distance is the number of
words put in, left out or replaced.

1. Items are grouped in bands of similar length, and every text is read in windows of a band's length. A window takes part
   only if it holds enough pairs of neighbouring words that occur in the items of the band: an item with at most `1 - similarity`
   of its words edited keeps more of its pairs than that, so no leak is lost here. All
   windows that do are embedded, also side by side: a leak beside a denser stretch is met by the windows at its own start.
2. The CGK walk embeds windows and items: it reads a word again and again until a random bit, which depends on the
   step and the word, moves it on. Texts at a small edit distance then agree at most steps.
3. Locality-sensitive hashing: each repetition draws a new walk and samples a few steps; a window and an item whose
   sampled words agree are candidates. The number of repetitions follows from the recall wanted.
4. Each candidate is decided by the exact edit distance of the item to the best-matching part of the text around the window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tables import lean
from cloudloom.llm.words import mix, slices, split_words, window_codes

SIMILARITY = 0.8
SAMPLED = 2  # steps per repetition
RECALL, AGREEMENT = 0.99, 0.25  # recall wanted, and the share of steps at which near texts agree at least
BAND = 1.2  # ratio of lengths in a band
MIN_WORDS = 8  # items below are found only whole
BLOCK_ITEMS = 20_000  # items that are sent to the tasks at once
MATCHED = 1 << 16  # windows that are embedded at once
SLOTS = 1 << 22
SEED = np.uint64(0x5851F42D4C957F2D)


def repetitions(recall: float, agreement: float, sampled: int) -> int:
    """Draws after which a pair that agrees at a share `agreement` of steps is missed with probability 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


class Walk:
    """Sampled steps of the CGK embedding, for `count` repetitions."""

    def __init__(self, count: int, sampled: int):
        rng = np.random.default_rng(7)
        self.share = rng.random((count, sampled))
        self.salt = mix(np.arange(1, count + 1, dtype=np.uint64) * SEED)

    def keys(self, rows: np.ndarray, length: np.ndarray, base: np.ndarray, repetition: int) -> np.ndarray:
        """One hash per row of words (padded with 0): the words read at the sampled steps. Steps are drawn within twice
        the `base` length of a row, so that all rows of one band agree on them."""
        out = np.full(len(rows), self.salt[repetition])
        for b in np.unique(base):
            pick = np.flatnonzero(base == b)
            words, size = rows[pick], length[pick]
            steps = np.sort((self.share[repetition] * (2 * b)).astype(np.int64)).tolist()
            # words of all rows in one line, each row with 0 behind it, where a walk over its end stays
            width = int(size.max()) + 1
            line = np.zeros((len(pick), width), np.uint64)
            line[:, :-1] = words[:, : width - 1]
            line, begin = line.ravel(), np.arange(len(pick)) * width
            at, last, key = begin.copy(), begin + size, out[pick]
            for j in range(steps[-1] + 1):
                word = line.take(at)
                for s in range(steps.count(j)):
                    key = mix((key ^ word) + np.uint64(s + 1))
                turn = (word ^ (self.salt[repetition] + np.uint64(j))) * SEED
                at += ((turn ^ (turn >> np.uint64(29))) >> np.uint64(28) & np.uint64(1)).view(np.int64)
                np.minimum(at, last, out=at)
            out[pick] = key
        return out


def edit_distance(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each item to the nearest run of words of its part."""
    m, n = max(map(len, items)), max(map(len, parts))
    a, b = np.zeros((len(items), m), np.uint64), np.ones((len(items), n), np.uint64)
    for k, (x, y) in enumerate(zip(items, parts)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    inside = np.arange(n + 1)[None, :] <= np.array([len(p) for p in parts])[:, None]
    length = np.array([len(x) for x in items])
    row, slope = np.zeros((len(items), n + 1), np.int32), np.arange(n + 1, dtype=np.int32)
    best = np.zeros(len(items), np.int64)
    for i in range(m):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b))
        new = np.minimum.accumulate(new - slope, axis=1) + slope  # words of the part put in between
        row = new
        ends = length == i + 1
        best[ends] = np.where(inside[ends], row[ends], m + n).min(axis=1)
    return best


class Items:
    """The benchmark as words, bands, known word pairs and hashed embeddings."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity = similarity
        rows = [(i, t) for i, t in zip(ids, texts) if t]
        words = split_words(*_bytes([t for _, t in rows]), lower=True, punctuation=True)
        cut = [words.code[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        keep = [k for k, c in enumerate(cut) if len(c)]
        self.ids, self.words = [rows[k][0] for k in keep], [cut[k] for k in keep]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.limit = np.floor((1 - similarity) * self.length + 1e-9).astype(np.int64)
        self.known = np.zeros(SLOTS, bool)
        pairs = [window_codes(w, 2) for w in self.words if len(w) > 1]
        if pairs:
            self.known[(np.concatenate(pairs) & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        low = np.log(np.maximum(self.length, 1)) / np.log(BAND)
        self.band = np.floor(low + 1e-9).astype(np.int64)
        self.short = np.flatnonzero(self.length < MIN_WORDS)
        self.base = {b: int(self.length[(self.band == b) & (self.length >= MIN_WORDS)].min()) for b in np.unique(self.band[self.length >= MIN_WORDS])}
        long = np.flatnonzero(self.length >= MIN_WORDS)
        self.base_of = np.array([self.base.get(b, 0) for b in self.band.tolist()], np.int64)
        # the pairs of each band by themselves: a leak of an item of one band is no window for the others
        self.pairs = {b: np.unique(np.concatenate([window_codes(self.words[k], 2) for k in long[self.band[long] == b]])) for b in self.base}
        self.count = repetitions(recall, AGREEMENT, SAMPLED)
        self.walk = Walk(self.count, SAMPLED)
        self.index = []  # per repetition: sorted keys, and the item of each
        if len(long):
            padded = _pad([self.words[k] for k in long])
            base = np.array([self.base[self.band[k]] for k in long])
            for r in range(self.count):
                keys = self.walk.keys(padded, self.length[long], base, r)
                order = np.argsort(keys)
                self.index.append((keys[order], long[order]))
        self.exact = {}  # short items, by length: hash of all words -> items
        for k in self.short:
            n = int(self.length[k])
            self.exact.setdefault(n, {}).setdefault(int(window_codes(self.words[k], n)[0]), []).append(int(k))

    def least_pairs(self, n: int, base: int) -> float:
        """Known pairs that a window of `base` words must hold if it lies in a leak of an item of up to base * BAND words.
        Each edit breaks two pairs at most; a window shorter than the item by x words misses x of them."""
        most = max(base, int(base * BAND))
        return min((m - 1) - 2 * math.floor((1 - self.similarity) * m + 1e-9) - (m - base) for m in range(base, most + 1))

    def find(self, batch) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance) of all leaks in texts given as (index of the first, words of some); start
        and end in words of the text."""
        found, windows = [], []
        for row, words in batch:
            if len(words.code):
                found += self._short(row, words)
                for window in self._windows(row, words):
                    if len(windows) >= MATCHED and _cell(window) != _cell(windows[-1]):
                        found += self._match(windows)
                        windows = []
                    windows.append(window)
        return found + (self._match(windows) if windows else [])

    def _short(self, row, words):
        """Whole occurrences of the items that are too short for edits."""
        code, first = words.code, words.first
        text = words.text_of()
        found = []
        for n, wanted in self.exact.items():
            if len(code) < n:
                continue
            codes = window_codes(code, n)
            keys = np.array(sorted(wanted), np.uint64)
            place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            for s in np.flatnonzero((keys[place] == codes) & (text[: len(codes)] == text[n - 1 :])):
                found += [(row + int(text[s]), k, int(s - first[text[s]]), int(s + n - first[text[s]]), 0) for k in wanted[int(codes[s])]]
        return found

    def _windows(self, row, words):
        """All windows that hold enough known pairs: (text, base, first word of the window, words around it, where they start)."""
        code, first = words.code, words.first
        if not self.base or len(code) < 2:
            return
        text = words.text_of()
        stop = first[text + 1]  # of the text of each word: what lies beyond it counts for no window
        codes = window_codes(code, 2)
        near = np.flatnonzero(self.known[(codes & np.uint64(SLOTS - 1)).astype(np.int64)])
        codes, place = codes[near], np.arange(len(code))
        for band, base in self.base.items():
            own = self.pairs[band]
            hit = near[own[np.minimum(np.searchsorted(own, codes), len(own) - 1)] == codes]
            if not len(hit):
                continue
            sums = np.zeros(len(code), np.int32)
            sums[hit + 1] = 1
            np.cumsum(sums, out=sums)
            held = sums[np.minimum(place + base, stop) - 1] - sums
            at = np.flatnonzero(held >= max(1, self.least_pairs(0, base)))
            t = text[at]
            slack = int((1 - self.similarity) * base * BAND) + max(1, base // 4)
            begin = np.maximum(first[t], at - slack)
            end = np.minimum(first[t + 1], at + int(base * BAND) + 1 + slack)
            for x, w, a, b, f in zip(t.tolist(), at.tolist(), begin.tolist(), end.tolist(), first[t].tolist()):
                yield row + x, base, w - a, code[a:b], a - f

    def _match(self, windows):
        """Leaks among the windows of many texts. Equal windows are embedded once."""
        cut = [part[at : at + base] for _, base, at, part, _ in windows]
        names: dict = {}
        which = np.array([names.setdefault((w[1], c.tobytes()), len(names)) for w, c in zip(windows, cut)])
        _, one = np.unique(which, return_index=True)
        rows, length = _pad([cut[i] for i in one]), np.array([len(cut[i]) for i in one])
        base = np.array([windows[i][1] for i in one])
        pairs, n = [], len(self.words)
        for r, (keys, owner) in enumerate(self.index):
            mine = self.walk.keys(rows, length, base, r)
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            many = hi - lo
            w = np.repeat(np.arange(len(rows)), many)
            k = owner[np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)]
            same = self.base_of[k] == base[w]
            pairs.append(w[same] * n + k[same])
        met = np.unique(np.concatenate(pairs))
        of: dict = {}
        for w, k in zip((met // n).tolist(), (met % n).tolist()):
            of.setdefault(w, []).append(k)
        # windows side by side that met one item are compared as one part of the text, and equal parts once
        parts: dict = {}
        for i, w in enumerate(which.tolist()):
            for k in of.get(w, ()):
                part = parts.setdefault((_cell(windows[i]), k), [i, i])
                part[1] = i
        todo: dict = {}
        for ((text, _, _), k), (i, j) in parts.items():
            first, last = windows[i], windows[j]
            around = np.concatenate([first[3], last[3][max(0, first[4] + len(first[3]) - last[4]) :]])
            todo.setdefault((k, around.tobytes()), []).append((text, first[4], around))
        out, todo = [], list(todo.items())
        for n in range(0, len(todo), 512):
            some = todo[n : n + 512]
            distance = edit_distance([self.words[k] for (k, _), _ in some], [places[0][2] for _, places in some])
            for ((k, _), places), d in zip(some, distance.tolist()):
                if d <= self.limit[k]:
                    out += [(text, k, start, start + len(around), d) for text, start, around in places]
        return out


def _cell(window) -> tuple[int, int, int]:
    """Text, base, and which half of a base of the text the window begins in: a matter of the text alone, not of the texts beside it."""
    text, base, inside, _, start = window
    return text, base, (start + inside) // (base // 2)


def _bytes(texts: list[str]):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), offsets


def _pad(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.uint64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


HITS = "array<struct<item:long,distance:int,start:int,end:int>>"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """All columns of `docs` with `leaks`: item, distance and the stretch (in words) of every item found, sorted by item.

    An item of n words (MIN_WORDS or more) is found where a run of words lies within (1 - similarity) * n edits of it;
    shorter items are found whole only. Per item the nearest occurrence of a text is told. Null and empty texts or items have no
    leaks. The benchmark goes to the tasks in blocks of BLOCK_ITEMS items, one pass over `docs` each. No rows give
    no rows; a column named leaks is replaced.
    """
    items = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("t")).filter("length(t) > 0 AND id IS NOT NULL")
    block = F.pmod(F.xxhash64("id", "t"), F.lit(max(1, math.ceil(items.count() / BLOCK_ITEMS))))
    n_blocks = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    own = [c for c in docs.columns if c != "leaks"]
    out = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text"), F.array().cast(HITS).alias("leaks"))
    row_type = out.schema["_row"].dataType.simpleString()
    for b in range(n_blocks):
        rows = items.filter(block == b).orderBy("id", "t").collect()
        model = Items([r["id"] for r in rows], [r["t"] for r in rows], similarity, recall)

        def fn(batches, model=model):
            kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                hits = batch.column("leaks").to_pylist()
                best: dict = {}
                texts = ((row, split_words(data, offsets, lower=True, punctuation=True)) for row, data, offsets in slices(batch.column("_text")))
                for t, k, a, e, d in model.find(texts):
                    key, hit = (t, model.ids[k]), (d, a, e)
                    best[key] = min(best.get(key, hit), hit)
                for (t, item), (d, a, e) in best.items():
                    hits[t].append({"item": item, "distance": d, "start": a, "end": e})
                hits = [sorted(h, key=lambda x: x["item"]) for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("_text"), pa.array(hits, kind)],
                    schema=pa.schema([batch.schema.field("_row"), batch.schema.field("_text"), ("leaks", kind)]),
                )

        out = out.mapInArrow(lean(fn), f"_row {row_type}, _text string, leaks {HITS}")
    return out.select("_row.*", "leaks")
