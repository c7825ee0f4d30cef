"""Words as the contracts cut them: runs of anything but space and \\x09-\\x0D."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six separators, and the same as a pattern of what is no separator.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A-Z to a-z and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with memory that is free given back to the system after each: two workers share an executor's."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        if trim:
            trim(0)


def split(text: str | None) -> list[bytes]:
    """UTF-8 words. bytes.split() cuts at exactly the six separators. Lone surrogates can't come from Spark."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only."""
    return text.encode().translate(LOWER).split() if text else []


def strings(column: pa.Array) -> list[str]:
    """A text column's values, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words (A-Z only), each token's place among them, and how many each text has. No end tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    coded = parts.values.dictionary_encode()
    index, offsets = coded.indices.to_numpy(), parts.offsets.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    sizes = np.diff(offsets)
    if empty >= 0:  # before a first and after a last separator
        real = index != empty
        count = np.concatenate([[0], np.cumsum(real)])
        sizes, index = np.diff(count[offsets]), index[real]
    return coded.dictionary, index, sizes.astype(np.int64)
