"""Words of documents as keyed counts: the part that the language models share."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .textcore import LOWER, hash_spans, text_bytes, words


class Tokens:
    """Lower-cased (A-Z) words of a column of texts: spans in `data`, 64-bit keys, and the offsets between texts."""

    def __init__(self, column, lower: bool = True):
        data, offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.starts, self.lengths, self.offsets = words(self.data, offsets)
        self.keys = hash_spans(self.data, self.starts, self.lengths)
        self._texts = data, offsets

    @cached_property
    def text_keys(self) -> np.ndarray:
        """A 64-bit key of each text as it stands; made on demand, since it takes as long as the words."""
        data, offsets = self._texts
        return hash_spans(data, offsets[:-1], np.diff(offsets), seed=5)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
