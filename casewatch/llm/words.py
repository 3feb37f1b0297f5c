"""Hashes of words and of runs of words, computed for many documents at once inside Arrow tasks.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). Hashes are polynomials modulo
2**64 over a table of byte values, finished by a mixer, so equal words have equal hashes in every task. Such
polynomials fail on long regular sequences (a Thue-Morse word of 2,048 items and its complement are equal for every
base), so words from LONG bytes on are hashed by BLAKE2, and runs of any length that must be told apart by
`run_identities`, modulo the prime 2**61 - 1.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from casewatch import session

MASK = (1 << 64) - 1
LONG = 256
PRIME = (1 << 61) - 1
_PRIME_BASE = 0x0B2C7A91D3E5F047
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2F
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept and grown per worker."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a slice of documents: `first[i]` to `first[i + 1]` are the words of document i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def until(self) -> np.ndarray:
        """For each word the index after the last word of its document."""
        return np.repeat(self.first[1:], np.diff(self.first))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the items from `starts` to before `ends`, whatever stands around them."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items, also those across documents (callers mask them)."""
    count = max(len(sums) - n, 0)
    return mix((sums[n:] - sums[:count]) * powers(len(sums))[1][:count]) if count else np.zeros(0, dtype=np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, from halves of 31 and 30 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a0 * b1 + a1 * b0
    carried = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _reduced(a1 * b1 * np.uint64(2) + carried + a0 * b0)


_prime_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `powers`, modulo PRIME."""
    for k, base in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME))):
        while len(_prime_powers[k]) < n:
            known = _prime_powers[k]
            step = np.uint64(pow(base, len(known), PRIME))
            _prime_powers[k] = np.concatenate([known, _times(known, step)])
    return _prime_powers[0], _prime_powers[1]


def run_identities(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the items from `starts` to before `ends` that also tells long regular runs apart."""
    forward, back = prime_powers(len(hashes) + 1)
    terms = _times(_reduced(hashes), forward[: len(hashes)])
    low, high = (np.zeros(len(hashes) + 1, dtype=np.uint64) for _ in range(2))
    np.cumsum(terms & np.uint64((1 << 30) - 1), out=low[1:])
    np.cumsum(terms >> np.uint64(30), out=high[1:])
    sums = _reduced(_times(_reduced(high), np.uint64(1 << 30)) + _reduced(low))
    return mix(_times(_reduced(sums[ends] + np.uint64(PRIME) - sums[starts]), back[starts]), 13)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words of the documents whose bytes are data[offsets[i]:offsets[i + 1]]; offsets start at 0.

    `between` says of each byte value whether it separates words; `lower` treats A-Z as a-z.
    """
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64))
    inside = ~between[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    at = offsets[(offsets > 0) & (offsets < len(data))]  # a document's border also ends a word
    begin[at] = inside[at]
    stop[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    table = _BYTES[_LOWER] if lower else _BYTES
    hashes = run_hashes(prefix_sums(table[data]), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG):
        word = data[starts[i] : ends[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets from 0) of consecutive rows of about `most` bytes; null text is empty.

    A longer document is a slice of its own, so memory follows the longest document, not the batch.
    """
    array = column.cast(pa.large_binary()).fill_null(b"")
    _, offset_buffer, data_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(array):
        end = max(int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1, row + 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Documents may be long: few rows in each Arrow batch, and the AQE settings that split hot keys."""
    session.tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = session.scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """`stored`, with aggregates of the rows taken while they are written: no second job."""
    seen = Observation()
    back = stored(df.observe(seen, *(m.alias(k) for k, m in measures.items())), name)
    return back, seen.get


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of the frame's."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem = f"_{stem}_{uuid.uuid4().hex[:8]}"
    return stem


def file_system(path: str):
    """(file system, path in it) of a folder in the shared store, for reads and writes inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)
