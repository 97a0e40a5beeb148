"""Words of whole Arrow text columns, vectorised.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """Words of several texts: codes into ``distinct``; text i owns codes[bounds[i]:bounds[i + 1]]."""

    codes: np.ndarray
    distinct: pa.Array
    bounds: np.ndarray


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Nulls and blank texts have no words.  ``lower`` folds A-Z only."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    if empty.any():  # a blank text is split into one empty word
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        counts[empty] = 0
    encoded = pc.dictionary_encode(flat)
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, bounds)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of several runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out
