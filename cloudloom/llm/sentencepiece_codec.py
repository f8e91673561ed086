"""SentencePiece (merge type) encoding by a prefix table, and decoding.

Every prefix of a piece sequence has one encoding, so it has one last token. The table stores that token for each
prefix: among the pieces that end there, as an automaton over the vocabulary finds them, it is the one whose
neighbour to the left, the last token of the prefix before it, it can stand beside without merging. Reading the
table backwards gives the ids. Whether two tokens can stand side by side follows from the merges inside them.

No piece of the vocabularies handled here has the space mark after another character, but for runs of marks.
Texts are therefore cut before every mark, and the table of a cut is kept for the next time it comes.
"""

from __future__ import annotations

import re
import sys
import types

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tables import lean

MARK = "▁"  # fixed: stands for a space
CACHE = 200_000  # cuts that a task remembers, and as many from before
REPLACEMENT = "�"


class Vocabulary:
    """Pieces of a model file: their ids, order of merging and inner splits."""

    def __init__(self, model_file: str):
        self.model_file = model_file
        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        score = [lib.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if i not in special]
        # runs of marks merge last and from the left, so that a long one is cut into the longest from there
        self.marks = {len(self.pieces[i]): i for i in plain if set(self.pieces[i]) == {MARK}}
        self.longest_run = max(self.marks, default=1)
        self.rest_of_run = [self._merge_marks(n) for n in range(self.longest_run)]
        self.ids = {self.pieces[i]: i for i in plain if len(self.pieces[i]) == 1 or set(self.pieces[i]) != {MARK}}
        if any(MARK in p[1:] for p in self.ids):
            raise ValueError("a piece holds the space mark after another character")
        self.rank = {i: (-score[i], i) for i in self.ids.values()}
        order = {i: r for r, i in enumerate(sorted(self.rank, key=self.rank.get))}
        single = {i for p, i in self.ids.items() if len(p) == 1}
        # characters are there before any merge
        self.rank = {i: -1 if i in single else r for i, r in order.items()}
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.split: dict[int, tuple[int, int]] = {}
        for p in sorted(self.ids, key=len):
            if len(p) > 1:
                halves = self._merge(p)
                if halves is None:  # its own text never merges into it
                    continue
                self.split[self.ids[p]] = halves
        self.known = set(p for p in self.ids if len(p) == 1)
        inside = "".join(map(re.escape, sorted(self.known)))
        self.runs = re.compile(f"[{inside}]+|[^{inside}]", re.DOTALL)
        self.usable = {p: i for p, i in self.ids.items() if len(p) == 1 or i in self.split}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def _merge_marks(self, n: int) -> list[int]:
        parts, k = [1] * n, 0
        while k + 1 < len(parts):
            if parts[k] + parts[k + 1] in self.marks:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                k = 0
            else:
                k += 1
        return [self.marks[m] for m in parts]

    def _merge(self, text: str) -> tuple[int, int] | None:
        """The two tokens whose merge, the last of all, gives `text`; None if merging ends otherwise."""
        parts = list(text)
        if any(c not in self.ids for c in parts):
            return None
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None


class Codec:
    """Encoder of one task, with its memory of cuts and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.cuts: dict[str, tuple[str, int, bool]] = {}
        self.old: dict[str, tuple[str, int, bool]] = {}  # what `cuts` held before it was full
        self.name = [f" {i}" for i in range(len(vocabulary.pieces))]

    def compatible(self, a: int, b: int) -> bool:
        """True if the tokens a, b stay as they are when their texts are joined.

        Beside the border stand, as merging goes on, ever larger right parts of `a` and left parts of `b`. They
        must not merge with each other before they become part of the next larger one. Of two equal merges the left comes first.
        """
        pieces, ids, rank, split = self.v.pieces, self.v.ids, self.v.rank, self.v.split
        left_until = right_until = 1 << 60  # when the part beside the border is merged away
        while True:
            joint = ids.get(pieces[a] + pieces[b])
            if joint is not None:
                r = rank[joint]
                if r < left_until and r <= right_until:
                    return False
            if rank[a] >= rank[b]:
                if a not in split:
                    return True
                left_until, a = rank[a], split[a][1]
            else:
                right_until, b = rank[b], split[b][0]

    def table(self, text: str) -> list[int]:
        """Ids of `text`, a run of characters that the vocabulary knows, by the last token of every prefix."""
        last = [-1] * (len(text) + 1)
        pairs, fits = self.pairs, self.compatible
        for end, (token, n) in self.v.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue  # the one that fits is found
            begin = end - n
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                pair = before << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = fits(before, token)
                if not ok:
                    continue
            last[end] = token
        ids, at, length = [], len(text), self.v.length
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def cut(self, text: str) -> tuple[str, int, bool]:
        """Encoding of a cut: ids as text, their number, and whether the mark at its start stands alone."""
        found = self.old.get(text)
        if found is None:
            v = self.v
            if v.known.issuperset(text):
                ids = self.table(text)
                alone = ids[0] == v.marks.get(1)
                name = self.name
                found = ("".join([name[i] for i in (ids[1:] if alone else ids)]), len(ids) - alone, alone)
            else:  # nothing merges over a character that no piece has
                parts, count, alone = [], 0, False
                for k, run in enumerate(v.runs.findall(text)):
                    if run[0] in v.ids:
                        ids, n, first = self.cuts.get(run) or self.cut(run)
                        alone |= first and k == 0
                        parts.append(ids)
                    else:
                        ids = [v.bytes[b] for b in run.encode()] if v.bytes else [v.unknown]
                        n = len(ids)
                        parts += [self.name[i] for i in ids]
                    count += n
                found = ("".join(parts), count, alone)
        if len(self.cuts) >= CACHE:
            self.old = self.cuts.copy()
            self.cuts.clear()
        if len(self.pairs) >= 2 * CACHE:
            self.pairs.clear()
        self.cuts[text] = found
        return found

    def encode(self, text: str) -> tuple[str, int]:
        """Ids in decimal joined by spaces, the end id last, and how many they are."""
        v, name = self.v, self.name
        out, count, pending = [], 1, 0
        if text:
            known, cut = self.cuts.get, self.cut
            for word in text.replace(" ", MARK).split(MARK):
                key = MARK + word
                ids, n, alone = known(key) or cut(key)
                if alone:
                    pending += 1
                if pending and n:
                    run = self._run(pending)
                    out += [name[m] for m in run]
                    count += len(run)
                    pending = 0
                out.append(ids)
                count += n
            run = self._run(pending)
            out += [name[m] for m in run]
            count += len(run)
        out.append(name[v.end])
        return "".join(out)[1:], count

    def forget(self):
        """Gives the memory of cuts and pairs back."""
        self.pairs.clear()
        self.cuts.clear()
        self.old.clear()

    def _run(self, n: int) -> list[int]:
        """Tokens of `n` marks that merge with nothing but each other."""
        full, rest = divmod(n, self.v.longest_run)
        return [self.v.marks[self.v.longest_run]] * full + self.v.rest_of_run[rest]


class Decoder:
    """Ids to text: pieces in a row, byte tokens as UTF-8, marks as spaces, without the mark put in front."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.text = {str(i): p.replace(MARK, " ") for i, p in enumerate(v.pieces)} | {str(i): "" for i in v.silent}
        # an ASCII byte is a character; others wait, as lone surrogates, for the whole run
        self.text |= {str(i): chr(b) if b < 128 else chr(0xDC00 + b) for b, i in v.bytes.items()}
        self.byte_tokens = {str(i) for i in v.bytes.values()}
        self.waiting = re.compile("[\udc80-\udcff]+")

    def decode(self, ids: str) -> str:
        tokens = ids.split(" ")
        text = "".join(map(self.text.__getitem__, tokens))
        text = self.waiting.sub(lambda m: _utf8(bytes(ord(c) - 0xDC00 for c in m[0])), text)
        return text[1:] if text.startswith(" ") and tokens[0] not in self.byte_tokens else text


def _utf8(data: bytes) -> str:
    """UTF-8 in which every byte that is part of no character becomes a replacement sign."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(REPLACEMENT)
                i += 1
        return "".join(out)


def _coders(model_file: str) -> tuple[Codec, Decoder]:
    """One pair per worker process and file. The vocabulary (20 MB) lasts from task to task, the memory of cuts does not.
    Functions travel to the workers with copies of their globals, so what is to last lies in a module of its own."""
    state = vars(sys.modules.setdefault("_coders_of_this_worker", types.ModuleType("_coders_of_this_worker")))
    if model_file not in state:
        vocabulary = Vocabulary(model_file)
        state[model_file] = Codec(vocabulary), Decoder(vocabulary)
    return state[model_file]


def encode_decode(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with n_tokens, ids (decimal, joined by one space, the end id last) and decoded.

    `model_file` must lie at the same path on every executor. Null and empty texts give the end id alone and ''. No rows give
    no rows; columns named like a result are replaced. Texts of any length are encoded whole.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    packed = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text"))
    row_type = packed.schema["_row"].dataType.simpleString()

    def fn(batches):
        codec, decoder = _coders(model_file)
        try:
            for batch in batches:
                counts, ids, texts = [], [], []
                for text in batch.column("_text").to_pylist():
                    line, n = codec.encode(text or "")
                    ids.append(line)
                    counts.append(n)
                    texts.append(decoder.decode(line))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    schema=pa.schema([batch.schema.field("_row"), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())]),
                )
        finally:  # workers outlive tasks and queries
            codec.forget()

    out = packed.mapInArrow(lean(fn), f"_row {row_type}, n_tokens long, ids string, decoded string")
    return out.select("_row.*", "n_tokens", "ids", "decoded")
