"""Words of many texts at once, as places in their bytes; shared by the operators that work on word positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at once, of whole texts.
SLICE = 4 << 20
#: Bytes of words between white space: all but 0x20 and 0x09 to 0x0D. Bytes over 0x7F belong to letters and signs.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """The words of texts that lie end to end in data: first and last byte, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.data, self.inside = data, inside
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        #: The word at which each text begins; one more than there are texts.
        self.edge = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.LargeBinaryArray:
        size = np.r_[0, np.cumsum(self.end - self.start)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(size), pa.py_buffer(self.data[self.inside])])

    def joined(self, at: np.ndarray, edge: np.ndarray) -> pa.Array:
        """A text for each range edge[k]:edge[k + 1] of at: these words, joined by one space."""
        size = self.end[at] - self.start[at] + 1
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        source = np.repeat(self.start[at] - stop + size, size) + np.arange(total)
        out = self.data[np.minimum(source, len(self.data) - 1)] if total else np.zeros(0, np.uint8)
        out[stop - 1] = 0x20
        last = edge[1:][edge[1:] > edge[:-1]] - 1  # no space after the last word of a text
        keep = np.ones(total, bool)
        keep[stop[last] - 1] = False
        bounds = np.r_[0, stop][edge] - np.r_[0, np.cumsum(edge[1:] > edge[:-1])]
        return pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out[keep]))
