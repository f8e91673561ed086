"""Substring dedup by difference-cover anchors.

Positions of a text whose remainder modulo `period` lies in a difference cover carry an anchor. For any two
positions i and j some shift below `period` moves both onto the cover, so two equal windows of `window` words
share an anchor of `window - period + 1` words at one offset: no match is missed, and only
len(cover) / period of the positions are hashed. `repeats` then extends shared anchors to whole windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from cloudloom.llm.repeats import Anchors, drop_repeats
from cloudloom.llm.words import Words, window_starts

WINDOW, PERIOD = 35, 21


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue. Sets of up to six are searched; beyond that
    0..a-1 and the multiples of a, for a near sqrt(period), are thinned while they stay a cover."""
    full = set(range(period))
    for size in range(1, 7):
        if size * (size - 1) + 1 < period:
            continue
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if {(a - b) % period for a in cover for b in cover} == full:
                return list(cover)
    step = int(np.ceil(np.sqrt(period)))
    cover = sorted({*range(step), *range(0, period, step)})
    for x in list(cover):
        less = [c for c in cover if c != x]
        if {(a - b) % period for a in less for b in less} == full:
            cover = less
    return cover


@dataclass(frozen=True)
class CoverAnchors(Anchors):
    period: int
    cover: tuple[int, ...]

    def pick(self, words: Words) -> np.ndarray:
        on = np.zeros(self.period, bool)
        on[list(self.cover)] = True
        at = window_starts(words, self.size)
        return at[on[words.place()[at] % self.period]]


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD
) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts anywhere else.

    Returns one row per row of `docs`: `id_col`, n_words, n_removed, kept. Null or empty text: 0, 0, ''.
    Texts shorter than a window lose nothing. Equal rows are occurrences of each other. No rows give no rows;
    further columns of `docs` are ignored, whatever their names.
    """
    period = max(1, min(period, window))
    anchors = CoverAnchors(size=window - period + 1, reach=period - 1, period=period, cover=tuple(difference_cover(period)))
    return drop_repeats(docs, anchors, window, id_col, text_col)
