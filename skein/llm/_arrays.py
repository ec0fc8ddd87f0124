"""Large count arrays gathered from all tasks, and hashing of words and n-grams with numpy."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
SCHEMA = "block int, part int, data binary"
#: Bytes of text hashed at once, and of a batch worked on at once.
PIECE, BATCH_BYTES = 1 << 18, 8 << 20


def send(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's counts (64-bit or less) that aren't zero, compressed."""
    z, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for k in range(0, len(counts), BLOCK):
        c = counts[k : k + BLOCK]
        if c.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([z.compress(c.astype("<i8").tobytes())], pa.binary())], ["block", "part", "data"])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``BATCH_BYTES``, so what Python makes of one is bounded."""
    for b in batches:
        step = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def lean(f: Callable) -> Callable:
    """``f`` over slices of its batches, giving memory back to the system when its task ends: Spark keeps workers for
    later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(sliced(batches))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return run


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def _add(t: pa.Table) -> pa.Table:
    out = None
    for x in t.column("data").to_pylist():
        c = unpack(x)
        out = c.copy() if out is None else out + c
    return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int32()), "part": pa.array([0], pa.int32()), "data": pa.array([zstandard.ZstdCompressor(level=1).compress(out.tobytes())], pa.binary())})


def gather(sent: DataFrame) -> DataFrame:
    """The sums of all tasks' blocks, in two rounds so that no group holds more than the root of their number."""
    fan = max(1, int(sent.rdd.getNumPartitions() ** 0.5))
    first = sent.withColumn("salt", F.col("part") % fan).groupBy("block", "salt").applyInArrow(_add, SCHEMA)
    return first.groupBy("block").applyInArrow(_add, SCHEMA)


def collect(gathered: DataFrame, size: int) -> np.ndarray:
    """The whole array; its size is fixed by the model's parameters, not by the corpus."""
    out = np.zeros(size, np.int64)
    for r in gathered.toLocalIterator():
        c = unpack(bytes(r.data))
        out[r.block * BLOCK : r.block * BLOCK + len(c)] = c
    return out


#: The start of a word after a space.
WORD = re.compile(rb"(?<=[\x00-\x20])[^\x00-\x20]+")
R = np.uint64(0x9E3779B97F4A7C15)
_P: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    if "p" not in _P or len(_P["p"]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _P["p"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, R)]), dtype=np.uint64)
            inv = np.uint64(pow(int(R), -1, 1 << 64))
            _P["i"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, inv)]), dtype=np.uint64)
    return _P["p"][:n], _P["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of bytes ``b``, which begin and end with a space: runs of bytes above 0x20."""
    edge = np.flatnonzero(np.diff((b > 32).view(np.int8))) + 1
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inv = powers(len(b))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p)])
    return mix((total[ends] - total[starts]) * inv[starts])


#: Texts in a piece of bytes: the row of each part, where its bytes begin, how many are its own (the rest belongs to the
#: next part of the same text), whether the last text goes on in the next piece.
Piece = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]


def pieces(texts: list[str | None]) -> Iterator[Piece]:
    """(rows, starts, own, bytes, more): texts joined in pieces of about ``PIECE`` bytes, a line feed before each and two
    after it. A longer text is cut before a word, and each part shows the word after it, too: n-grams of its own bytes
    are whole and none is lost. A word is never cut, so memory grows with the longest word."""
    rows: list[int] = []
    parts: list[bytes] = []
    owned: list[int] = []
    size = 0

    def out(more: bool) -> Piece:
        lengths = np.array([len(p) + 3 for p in parts])
        return np.array(rows), np.cumsum(lengths) - lengths + 1, np.array(owned), np.frombuffer(b"".join(b"\n" + p + b"\n\n" for p in parts), np.uint8), more

    for i, t in enumerate(texts):
        e = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(e):
            end = shown = len(e)
            if end - at > PIECE:
                end = next(WORD.finditer(e, at + PIECE), None)
                end = end.start() if end else len(e)
                shown = WORD.match(e, end).end() if end < len(e) else end
            rows.append(i)
            parts.append(e[at:shown])
            owned.append(end - at)
            size += end - at
            at = end
            if size >= PIECE:
                yield out(at < len(e))
                rows, parts, owned, size = [], [], [], 0
    if parts:
        yield out(False)
