"""Suffix-array dedup with a sparse suffix array.

Only suffixes that start at content-selected positions are kept: among every run of neighbouring words the one
with the smallest hash of its next `size` words (a minimiser). Equal passages select equal positions, so
two passages of `min_words` words share a kept suffix at one offset. The kept suffixes are sorted by the
hash of their first words, bucket by bucket; neighbours with equal heads are then extended left and right to
passages of `min_words` words, compared as whole windows (see `repeats`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cloudloom.llm.repeats import Anchors, drop_repeats
from cloudloom.llm.words import Words, window_codes, window_starts

MIN_WORDS, HEAD = 50, 16


@dataclass(frozen=True)
class MinimiserAnchors(Anchors):
    def pick(self, words: Words) -> np.ndarray:
        """Leftmost smallest hash among `reach + 1` neighbouring suffixes of one text."""
        span = self.reach + 1
        codes = window_codes(words.code, self.size)
        at = window_starts(words, self.size + self.reach)
        if not len(at):
            return at
        best, where, width = codes.copy(), np.arange(len(codes)), 1

        def merge(left, right):  # of two spans, the later one only if it is smaller
            (b, w), (c, v) = left, right
            less = c < b
            return np.where(less, c, b), np.where(less, v, w)

        while width * 2 <= span:  # sliding minimum by doubling
            best, where = merge((best[:-width], where[:-width]), (best[width:], where[width:]))
            width *= 2
        late = at + span - width
        _, found = merge((best[at], where[at]), (best[late], where[late]))
        return np.unique(found)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """Removes every word covered by a passage of `min_words` words that also starts anywhere else.

    Returns one row per row of `docs`: `id_col`, n_words, n_removed, kept. Null or empty text: 0, 0, ''.
    Texts shorter than `min_words` words lose nothing. Equal rows are occurrences of each other. No rows give
    no rows; further columns of `docs` are ignored, whatever their names.
    """
    head = min(head, min_words)
    anchors = MinimiserAnchors(size=head, reach=min_words - head)
    return drop_repeats(docs, anchors, min_words, id_col, text_col)
