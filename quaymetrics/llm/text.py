"""Arrow and numpy helpers that run inside tasks: bounded chunks, words, hashes, joins."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text that a task looks at together; its working arrays take some twenty times as much.
CHUNK_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts as none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        total = np.cumsum(text_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def merged(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Like chunks, but small neighbours are put together up to `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in chunks(batches, column, limit):
        n = int(text_bytes(part.column(column)).sum())
        if held and size + n > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.concat_batches(held)
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: workers are reused and would keep their largest task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_strings(column: pa.Array) -> pa.Array:
    """The texts with null as the empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


#: Bytes that part words: white space, or all ASCII that is neither letter nor digit.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of a column of texts as spans of one byte buffer, without copies of the words."""

    def __init__(self, column: pa.Array, parts: np.ndarray = SPACES, lower: bool = False):
        raw, self.offsets = raw_bytes(column)
        self.raw = LOWER[raw] if lower else raw
        inside = ~parts[raw]
        before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside.copy()
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside.copy()
        cuts = self.offsets[:-1]
        before[cuts[cuts < len(raw)]] = False
        cuts = self.offsets[1:]
        after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: the words of text i are bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.raw, self.starts, self.ends)

    def take(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words joined by one space."""
        counts = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
        starts, lengths = self.starts[keep], (self.ends - self.starts)[keep]
        out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        to = np.cumsum(lengths + 1) - lengths - 1
        out[ranges(to, lengths)] = self.raw[ranges(starts, lengths)]
        where = np.concatenate([[0], np.cumsum(lengths + 1)])[counts]
        stops = np.maximum(where[1:] - 1, where[:-1])  # without the last word's space
        return pa.array(
            [out[a:b].tobytes() for a, b in zip(where[:-1], stops, strict=True)], pa.binary()
        )


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and each text's offsets in them."""
    texts = pa.concat_arrays([as_strings(column)])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    offsets = offsets.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a step."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))
    left = ends - starts
    out = mix64(left.astype(np.uint64))
    which, at = np.arange(len(starts)), np.asarray(starts)
    while len(which):
        n = np.minimum(left, 8).astype(np.uint64)
        part = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n * np.uint64(8)))
        out[which] = mix64(out[which] + part * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True where any [start, end) lies."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not among those taken."""
    used = {t.lower() for t in taken}
    name = f"_{name}"
    while name.lower() in used:
        name = f"_{name}"
    return name
