"""Words of many texts at once, as Arrow arrays: all separators are single ASCII bytes, so UTF-8 is cut by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one lot, in bytes; a longer text is a lot of its own.
LOT = 6 << 20
WORD, BLANK, STOP = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def kinds(blank: bytes, stop: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a blank between words, or the end of a piece."""
    out = np.zeros(256, np.uint8)
    out[list(blank)] = BLANK
    out[list(stop)] = STOP
    return out


def lots(texts: pa.Array, size: int = LOT) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of at most size bytes together."""
    ends = np.cumsum(np.array(pc.binary_length(texts).fill_null(0), np.int64)) if len(texts) else np.zeros(0, np.int64)
    start, before = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end
        start, before = end, int(ends[end - 1])


def words(texts: pa.Array, kind: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, piece number, word) of every word, in order; pieces end at STOP bytes and at ends of texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if places is not None and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        raw = LOWER[raw]
    of = kind[raw]
    inside = of == WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = at[1:] > at[:-1]
    begin, end = at[:-1][filled], at[1:][filled] - 1
    first[begin] |= inside[begin]
    last[end] |= inside[end]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(at, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(of == STOP), start) + text
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    return text, piece, pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])


def lists_of_one(values: pa.Array) -> pa.Array:
    """An array of one list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def released() -> None:
    """Gives what arrays no longer use back to the system; a worker lives on with other tasks."""
    pa.default_memory_pool().release_unused()


def packed_records(records: np.ndarray) -> bytes:
    """An array of one fixed-width type as compressed byte planes."""
    width = records.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(records).view(np.uint8).reshape(-1, width).T)
    return len(records).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def unpacked_records(data: bytes, kind: np.dtype | str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def packed(numbers: np.ndarray, rising: bool = False, width: int = 4) -> bytes:
    """Whole numbers, packed; those that only rise as their differences."""
    return packed_records((np.diff(numbers, prepend=0) if rising else numbers).astype(f"<i{width}"))


def unpacked(data: bytes, rising: bool = False, width: int = 4) -> np.ndarray:
    numbers = unpacked_records(data, f"<i{width}")
    return np.cumsum(numbers) if rising else numbers
