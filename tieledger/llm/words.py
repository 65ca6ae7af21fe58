"""Words of whole batches of texts at once, as codes of a dictionary."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tieledger.llm.hashing import runs


class Words(NamedTuple):
    """The words of a batch in order: where each stands, in which text, and its code in ``names``."""

    starts: np.ndarray
    texts: np.ndarray
    codes: np.ndarray
    names: pa.Array


def bytes_in(*signs: int) -> np.ndarray:
    """A table by byte that is True for these ASCII signs; bytes of other characters are never among them."""
    table = np.zeros(256, bool)
    table[list(signs)] = True
    return table


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of texts, and where each text ends among them; a null is empty."""
    large = pa.compute.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def words_of(texts: pa.Array, between: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of texts, parted by the bytes in ``between``, and the bytes of all texts with a zero byte behind each.

    The added bytes are known by their place, so a zero byte within a text parts words only if it is in the table.
    """
    data, ends = column_bytes(texts)
    lengths = np.diff(ends)
    # room of one byte behind each text, so that no word goes on into the next
    spread = np.zeros(len(data) + len(lengths), np.uint8)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    spread[np.arange(len(data)) + text_of] = data
    inside = ~between[spread]
    inside[ends[1:] + np.arange(len(lengths))] = False
    first, stop = runs(inside)
    sizes = np.zeros(len(first) + 1, np.int64)
    np.cumsum(stop - first, out=sizes[1:])
    flat = pa.py_buffer(spread[inside])
    column = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(sizes), flat]).dictionary_encode()
    texts_at = np.searchsorted(ends[1:] + np.arange(len(lengths)), first, side="right")
    return Words(first, texts_at, column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary), spread
