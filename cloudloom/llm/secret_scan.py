"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds what they leave.

The field tags every token of a text as beginning (B), inside (I) or outside (O) a secret. A token is a run of signs that hold
values together, or one sign that parts them; it is told by its shape, how surprising its letters are, the words beside it and
features of the whole text. Decoding is Viterbi's over the whole chain: tokens which the weights prove to be O on
every best path are found first, for all tokens of a batch at once, and only what lies between them is walked.

The field is trained here, by maximum likelihood, on a bounded sample of texts whose secrets the patterns tell. So that it learns
values and not the patterns' own names, it also sees the sample with other names and values in place of its secrets, and with
harmless assignments, all made by a rule from the words of the sample.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
# fixed patterns
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
LEAST = {"assign": 8, "access": 16, "hex": 32}  # characters; of an assignment, of its value
_LONG_HEX = re.compile(r"[0-9a-f]{32}", re.ASCII)


TRAIN_TEXTS, TRAIN_CHARS = 3000, 4000  # distinct texts that train the field; a longer one gives a piece from a hashed place
FEATURES = 1 << 16
CHAIN = 64  # tokens of a chain in training; decoding takes whole texts
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.3, 1e-5
PIECE = 1 << 17  # characters whose tokens are told at once

_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
_PARTS = np.frombuffer("\"'`=:,;()[]{}<>|\\".encode("utf-32-le"), np.uint32)  # signs that are tokens of their own
_ENDS = np.frombuffer(".!?".encode("utf-32-le"), np.uint32)  # the same at the end of a token
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: a golden-ratio multiplier


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all secrets that the patterns tell, by start, then kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end(), m.start(1)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _LONG_HEX.search(text):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


@dataclass
class Tokens:
    """Tokens of neighbouring texts: the text of each, its place there, and the hashed features, tokens x templates."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    index: np.ndarray


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Characters as one of 192 symbols; capitals are small letters and digits are alike."""
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    low = np.where((low >= 48) & (low <= 57), 48, low)
    return np.where(low < 128, low, 128 + low % 64).astype(np.int64)


def _edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end characters of the tokens, and whether each is a sign that parts."""
    n = len(codes)
    small = codes < 128
    table = np.zeros(128, np.int8)  # 0: joins, 1: parts, 2: a space
    table[_PARTS] = 1
    table[_SPACES[_SPACES < 128]] = 2
    kind = np.where(small, table[np.where(small, codes, 0)], 0)
    kind[~small] = np.where(np.isin(codes[~small], _SPACES), 2, 0)
    joins = kind == 0
    # signs that end a run of joining characters part from it: no other character of the run comes after them
    place = np.arange(n)
    other = np.where(joins & ~np.isin(codes, _ENDS), place, n)
    stop = np.where(joins, n, place)
    next_other, next_stop = (np.minimum.accumulate(x[::-1])[::-1] for x in (other, stop))
    parts = (kind == 1) | (joins & (next_other >= next_stop))
    joins &= ~parts
    before = np.concatenate([[False], joins[:-1]])
    first = parts | (joins & ~before)
    after = np.concatenate([joins[1:], [False]])
    last = parts | (joins & ~after)
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, parts[start]


def _level(values, step, top):
    return np.minimum(values // step, top).astype(np.int64)


def _own(codes: np.ndarray, surprise: np.ndarray):
    """Of the tokens of a piece: places, hashes, and what their characters tell (one row of small numbers each)."""
    start, end, parts = _edges(codes)
    size = end - start
    symbol = _symbols(codes)

    def total(of):  # over the characters of each token
        run = np.concatenate([[0], np.cumsum(of)])
        return run[end] - run[start]

    def changes(of):  # over neighbouring characters within each token
        run = np.concatenate([[0], [0], np.cumsum(of)])
        return run[end] - run[start + 1]

    small, large, digit = ((codes >= a) & (codes <= b) for a, b in ((97, 122), (65, 90), (48, 57)))
    wide = codes >= 128
    hexes = digit | ((codes >= 97) & (codes <= 102))
    kind = small + 2 * large + 3 * digit + 4 * wide
    n_small, n_large, n_digit, n_wide, n_hex = (total(x) for x in (small, large, digit, wide, hexes))
    n_sign = size - n_small - n_large - n_digit - n_wide
    pairs = surprise[symbol[:-1], symbol[1:]] if len(codes) > 1 else np.zeros(0)
    strange = changes(pairs) / np.maximum(size - 1, 1)
    turns = changes(kind[1:] != kind[:-1]) if len(codes) > 1 else np.zeros(len(size), np.int64)
    made = (n_small > 0) + 2 * (n_large > 0) + 4 * (n_digit > 0) + 8 * (n_sign > 0) + 16 * (n_wide > 0)
    with np.errstate(over="ignore"):
        # a hash of the characters by their place in the token
        place = _places(start, len(codes)) % 64
        mixed = (symbol.astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX)
        mixed ^= mixed >> np.uint64(29)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        name = (run[end] - run[start]) * _MIX
    told = np.stack([
        _level(size, 2, 20), made, _level(n_digit * 8, size, 8), (n_hex == size).astype(np.int64), _level(strange, 0.5, 24), _level(turns * 8, size, 8), parts,
    ], 1)
    return start, end, name, told


def _places(start, n):
    """For each character, its place after the last token that starts at or before it."""
    at = np.zeros(n, np.int64)
    at[start] = start
    return np.arange(n) - np.maximum.accumulate(at)


def tell(texts: list[str], surprise: np.ndarray) -> Tokens:
    """All tokens of all texts with their features."""
    whole = "\n".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    got, at = [], 0
    while at < len(codes):  # in pieces that end at a space
        cut = min(at + PIECE, len(codes))
        while cut < len(codes):
            spaces = np.flatnonzero(np.isin(codes[cut : cut + PIECE], _SPACES))
            if len(spaces):
                cut += int(spaces[0])
                break
            cut = min(cut + PIECE, len(codes))
        start, end, name, told = _own(codes[at:cut], surprise)
        got.append((start + at, end + at, name, told))
        at = cut
    if not got:
        return Tokens(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 1), np.int32))
    start, end, name, told = (np.concatenate(x) for x in zip(*got))
    text = np.searchsorted(begins, start, side="right") - 1
    size, made, digits, hexes, strange, turns, parts = told.T

    def shifted(values, by):  # of the token `by` places on, zero where another text begins
        out = np.zeros_like(values)
        a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        same = text[a] == text[b]
        out[a] = np.where(same, values[b], 0)
        return out

    lines = np.array([min(t.count("\n"), 8) for t in texts])
    share = np.bincount(text, weights=digits > 0, minlength=len(texts)) * 8 // np.maximum(np.bincount(text, minlength=len(texts)), 1)
    file = lines * 100 + share.astype(np.int64) * 10 + np.minimum(sizes // 1000, 8)
    touches = (start > 0) & np.concatenate([[False], end[:-1] == start[1:]])
    touched = np.concatenate([touches[1:], [False]])
    look = size * 32 + made  # length and kinds of signs
    near = [shifted(name, -1), shifted(name, -2), shifted(name, -3), shifted(name, 1), shifted(name, 2)]
    assigned = np.where(shifted(parts, -1) == 1, near[0], np.uint64(0))
    templates = [
        np.zeros_like(size), size, made, look, look * 32 + strange, strange * 32 + size, digits * 32 + size, hexes * 32 + size, turns * 32 + size, made * 1024 + turns * 32 + strange,
        touches * 2 + touched, file[text], name, *near, assigned, (assigned % np.uint64(1 << 20)).astype(np.int64) * 4096 + strange * 32 + size,
        shifted(look, -1), shifted(look, 1), shifted(size * 32 + strange, -2) * 64 + touches * 2 + parts,
    ]
    with np.errstate(over="ignore"):
        index = [((t.astype(np.uint64) + np.uint64(k + 1) * _MIX) * _MIX >> np.uint64(48)).astype(np.int32) for k, t in enumerate(templates)]
    return Tokens(text, start - begins[text], end - begins[text], np.stack(index, 1))


class Field:
    """A linear-chain conditional random field over the tags O, B, I. `surprise` holds bits per pair of symbols."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, surprise: np.ndarray | None = None):
        self.weights, self.moves = weights, moves  # features x 3; 3 x 3, the first row also starts a chain
        self.surprise = np.zeros((192, 192)) if surprise is None else surprise

    def scores(self, feats) -> np.ndarray:
        return np.stack([self.weights[f].sum(0) for f in feats])

    def decode(self, feats) -> list[int]:
        """The likeliest tags of a chain (Viterbi). The tokens on both sides of it are O."""
        return self.walk(self.scores(feats))

    def walk(self, emit: np.ndarray) -> list[int]:
        best, back = emit[0] + self.moves[0], []
        for e in emit[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(0))
            best = paths.max(0) + e
        tags = [int((best + self.moves[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The likeliest tags of all texts. A token whose lead over O cannot make up for any moves beside it is O on every best path,
        so that the chain falls apart there without loss."""
        n = len(tokens.text)
        out, emit = np.zeros(n, np.int8), np.zeros((n, 3))
        for at in range(0, n, 1 << 15):
            emit[at : at + (1 << 15)] = self.weights[tokens.index[at : at + (1 << 15)]].sum(1)
        m = self.moves
        gain = (m[:, None, :] + m.T[None, :, :] - (m[:, :1] + m[:1, :])[:, :, None]).max((0, 1))  # best of m[p, t] + m[t, q] - m[p, O] - m[O, q]
        open_ = np.flatnonzero(((emit - emit[:, :1] + gain)[:, 1:] >= 0).any(1))
        if not len(open_):
            return out
        part = np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.text[open_]) != 0)) + 1
        for run in np.split(open_, part):
            out[run] = self.walk(emit[run])
        return out

    def gradients(self, emit: np.ndarray, mask: np.ndarray, tags: np.ndarray):
        """Of the log-likelihood of many chains, padded to one length: towards the scores of tokens, and towards the moves."""
        chains, n, _ = emit.shape
        m, rows = self.moves, np.arange(chains)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)

        def lse(x, axis):
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        forward[:, 0] = emit[:, 0] + m[0]
        for i in range(1, n):
            forward[:, i] = np.where(mask[:, i, None], emit[:, i] + lse(forward[:, i - 1, :, None] + m, 1), forward[:, i - 1])
        backward[:, -1] = m[:, 0]
        for i in range(n - 2, -1, -1):
            on = lse(m + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(mask[:, i + 1, None], on, m[:, 0])
        total = lse(forward[:, -1] + m[:, 0], 1)
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        towards = -marginal
        towards[rows[:, None], np.arange(n), tags] += mask
        last = mask.sum(1) - 1
        step = np.zeros((3, 3))
        step[0] += towards[:, 0].sum(0)
        step[:, 0] += towards[rows, last].sum(0)
        pair = np.exp(forward[:, :-1, :, None] + m + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        step -= (pair * mask[:, 1:, None, None]).sum((0, 1))
        np.add.at(step, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        return towards, step, total


def _spans_tags(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of the tokens: the first that begins in a value is B, further ones I."""
    tags = np.zeros(len(tokens.text), np.int64)
    bounds = np.searchsorted(tokens.text, np.arange(len(spans) + 1))
    for k, values in enumerate(spans):
        start = tokens.start[bounds[k] : bounds[k + 1]]
        for a, b in values:
            i, j = np.searchsorted(start, a), np.searchsorted(start, b)
            tags[bounds[k] + i : bounds[k] + j] = 2
            if j > i:
                tags[bounds[k] + i] = 1
    return tags


def _values(text: str) -> list[tuple[int, int]]:
    """Values that the patterns tell, as disjoint spans."""
    out = []
    for a, b in sorted((v, e) for _, _, e, v in base_spans(text)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SMALL, _LARGE, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Signs and lengths of values that stand in for the secrets of the sample.
VALUES = [
    ("0123456789abcdef", 16, 64), (_SMALL + _LARGE + _DIGITS, 12, 48), (_SMALL + _LARGE + _DIGITS + "+/", 16, 64), (_SMALL + _LARGE, 16, 40),
    (_SMALL, 16, 40), (_LARGE + _DIGITS, 16, 40), (_SMALL + _DIGITS, 8, 24), (_SMALL + _LARGE + _DIGITS + "!#$%&*+-?@^_~", 10, 32),
]


def _made_value(rng) -> str:
    if rng.random() < 0.2:  # letters, then a few digits
        return "".join(rng.choice(list(_SMALL), rng.integers(6, 14))) + "".join(rng.choice(list(_DIGITS), rng.integers(2, 5)))
    signs, least, most = VALUES[rng.integers(len(VALUES))]
    return "".join(rng.choice(list(signs), rng.integers(least, most + 1)))


def _assignment(name: str, value: str, rng) -> tuple[str, int]:
    """An assignment in one of the usual spellings, and where its value begins."""
    link = ["=", " = ", ": ", ":", "='", '="', ': "', " = '", '": "'][rng.integers(9)]
    quote = link[-1] if link[-1] in "'\"" else ""
    return name + link + value + quote, len(name) + len(link)


def _renamed(text: str, values: list[tuple[int, int]], words: list[str], rng, planted: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with other names and values in place of its secrets, `planted` more of them, and harmless assignments."""
    parts, spans, at, size = [], [], 0, 0

    def put(piece):
        nonlocal size
        parts.append(piece)
        size += len(piece)

    def name():
        return "_".join(words[rng.integers(len(words))] for _ in range(rng.integers(1, 3)))

    def secret():
        value = _made_value(rng)
        said, k = _assignment(name(), value, rng) if rng.random() < 0.85 else (value, 0)
        spans.append((size + k, size + k + len(value)))
        put(said)

    def harmless():
        value = [words[rng.integers(len(words))], str(rng.integers(10 ** rng.integers(1, 16))), f"{words[rng.integers(len(words))]}_{words[rng.integers(len(words))]}"][rng.integers(3)]
        put(_assignment(name(), value, rng)[0])

    taken = [(a, b) for a, _, b, _ in base_spans(text)]  # names and values
    gaps = [m.start() for m in re.finditer(r"\s", text) if not any(a <= m.start() < b for a, b in taken)]
    extra = sorted((gaps[rng.integers(len(gaps))], bool(k < planted)) for k in range(planted + 2)) if gaps else []
    events = sorted([(a, b, None) for a, b in values] + [(g, g, s) for g, s in extra], key=lambda e: e[:2])
    for a, b, what in events:
        if a < at:
            continue
        before = text[at:a]
        if what is None:  # the name before the value goes too
            before = re.sub(r"""[\w]+(["']?\s*[:=]\s*["']?)$""", lambda m: name() + m[1], before)
            put(before)
            value = _made_value(rng)
            spans.append((size, size + len(value)))
            put(value)
        else:
            put(before + " ")
            secret() if what else harmless()
        at = b
    put(text[at:])
    return "".join(parts), spans


def _sample(docs: DataFrame, text_col: str) -> list[str]:
    """At most TRAIN_TEXTS distinct texts by a hash of the text, each cut to TRAIN_CHARS characters from a hashed place."""
    rows = docs.select(F.col(text_col).alias("t")).filter(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    n = rows.select("h").distinct().count()
    pick = F.pmod("h", F.lit(1 << 40))
    if n > 4 * TRAIN_TEXTS:
        rows = rows.filter(pick < int((1 << 40) * 4 * TRAIN_TEXTS / n))
    begin = F.pmod("h", F.greatest(F.length("t") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(pick.alias("h"), F.col("t").substr(begin, F.lit(TRAIN_CHARS)).alias("t"))
    rows = rows.groupBy("h").agg(F.min("t").alias("t"))  # copies combine before they move
    return [r["t"] for r in rows.orderBy("h").limit(TRAIN_TEXTS).collect()]


def _surprise(texts: list[str], values) -> np.ndarray:
    """Bits of a symbol after another, from the texts without their secrets."""
    count = np.full((192, 192), 0.1)
    for text, spans in zip(texts, values):
        at = 0
        for a, b in [*spans, (len(text), len(text))]:
            symbol = _symbols(np.frombuffer(text[at:a].encode("utf-32-le", "surrogatepass"), np.uint32))
            if len(symbol) > 1:
                count += np.bincount(symbol[:-1] * 192 + symbol[1:], minlength=192 * 192).reshape(192, 192)
            at = b
    return -np.log2(count / count.sum(1, keepdims=True))


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """A field trained on the sample (see `_sample`) as it is, and with its secrets renamed. Without a secret in the sample it tags everything O."""
    return fit(_sample(docs, text_col))


def fit(texts: list[str]) -> Field:
    """A field trained on these texts, whose secrets the patterns tell."""
    values = [_values(t) for t in texts]
    surprise = _surprise(texts, values)
    field = Field(np.zeros((FEATURES, 3)), np.zeros((3, 3)), surprise)
    if not any(values):
        field.weights[:, 0] = 1
        return field
    rng = np.random.default_rng(11)
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]{2,16}", t)}) or ["name"]
    named = [k for k, v in enumerate(values) if v]
    more = [_renamed(texts[k], values[k], words, rng, 2) for k in named] + [_renamed(t, v, words, rng, int(k % 2)) for k, (t, v) in enumerate(zip(texts, values))]
    every, spans = [*texts, *[t for t, _ in more]], [*values, *[v for _, v in more]]
    index, tags, cuts = [], [], [np.zeros(0, np.int64)]
    done = 0
    for at in range(0, len(every), 500):
        tokens = tell(every[at : at + 500], surprise)
        index.append(tokens.index)
        tags.append(_spans_tags(tokens, spans[at : at + 500]))
        begin = np.searchsorted(tokens.text, np.unique(tokens.text))
        for a, b in zip(begin, [*begin[1:], len(tokens.text)]):
            cuts.append(np.arange(a, b, CHAIN) + done)
        done += len(tokens.text)
    index, tags, begin = np.concatenate(index), np.concatenate(tags), np.concatenate(cuts)
    length = np.minimum(np.diff(np.append(begin, done)), CHAIN)
    # chains with a secret are few: the others take turns, a share of them in every epoch
    held = np.add.reduceat(tags > 0, begin) > 0
    with_secret, without = np.flatnonzero(held), np.flatnonzero(~held)
    grow_w, grow_m = np.full((FEATURES, 3), 1e-6), np.full((3, 3), 1e-6)
    for _ in range(EPOCHS):
        turn = rng.permutation(without)[: max(4 * len(with_secret), 2000)]
        order = rng.permutation(np.concatenate([with_secret, turn]))
        for at in range(0, len(order), BATCH):
            chains = order[at : at + BATCH]
            n = length[chains]
            mask = np.arange(n.max()) < n[:, None]
            place = np.where(mask, begin[chains][:, None] + np.arange(n.max()), 0)
            feats = index[place]
            towards, step, _ = field.gradients(field.weights[feats].sum(2), mask, np.where(mask, tags[place], 0))
            flat = feats[mask]
            pull = np.stack([np.bincount(flat.ravel(), np.repeat(towards[mask][:, k], flat.shape[1]), FEATURES) for k in range(3)], 1)
            pull -= DECAY * field.weights
            grow_w += pull**2
            grow_m += step**2
            field.weights += RATE * pull / np.sqrt(grow_w)
            field.moves += RATE * step / np.sqrt(grow_m)
    return field


def all_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int, int]]]:
    """Per text: spans of the patterns, and those of the field that touch none of them, by start, then kind."""
    tokens = tell(texts, field.surprise)
    tags = field.tags(tokens)
    own: list[list[tuple[int, int]]] = [[] for _ in texts]
    last = -2
    for i in np.flatnonzero(tags):
        t, a, b = int(tokens.text[i]), int(tokens.start[i]), int(tokens.end[i])
        if tags[i] == 2 and last == i - 1 and own[t]:
            own[t][-1] = (own[t][-1][0], b)
        else:
            own[t].append((a, b))
        last = i
    out = []
    for text, more in zip(texts, own):
        base, free, k, reach = base_spans(text), [], 0, 0
        for a, b in more:
            while k < len(base) and base[k][0] < b:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= a:
                free.append((a, 3, b, a))
        out.append(sorted(base + free))
    return out


def spans_of(text: str, field: Field) -> list[tuple[int, int, int, int]]:
    """Spans of one text."""
    return all_spans([text], field)[0]


def _batches(texts: list[str | None]):
    """Lists of texts of about PIECE characters; a longer text is a list of its own."""
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > PIECE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


SPAN = "struct<kind:string,start:int,end:int>"


def scan_secrets(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `secrets`: kind, start and end (code points, end exclusive) by start, then kind.

    Spans of the fixed patterns always stay; spans of kind `crf` are what the field adds. Null and empty texts have none. No
    rows give no rows; a column named secrets is replaced. Whole texts are scanned.
    """
    own = [c for c in docs.columns if c != "secrets"]
    packed = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text"))
    row_type = packed.schema["_row"].dataType.simpleString()
    field = Field(field.weights.astype(np.float32), field.moves, field.surprise)  # about a megabyte, at any size

    def fn(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for texts in _batches(batch.column("_text").to_pylist()):
                found += [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in spans] for spans in all_spans(texts, field)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(found, kind)], schema=pa.schema([batch.schema.field("_row"), ("secrets", kind)])
            )

    return packed.mapInArrow(fn, f"_row {row_type}, secrets array<{SPAN}>").select("_row.*", "secrets")
