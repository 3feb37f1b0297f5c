"""Count-min sketches of 64-bit keys, made per task, merged in Spark, kept as one bitmap of repeated counters.

The bitmap has a fixed size (rows x width bits, a parameter), whatever the input; a fuller sketch only lets more
keys through, so callers stay exact and lose only the saving.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casewatch.llm import words as W

ROWS = 2
WIDTH_BITS = 27  # counters in a row: 2**27; both bitmaps together 32 MB
CHUNK_BITS = 19
TOP = 255


def counters(keys: np.ndarray, row: int) -> np.ndarray:
    return W.mix(keys, row + 1) >> np.uint64(64 - WIDTH_BITS)


def repeated_keys(source: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int = 2) -> np.ndarray:
    """uint8 [ROWS, width / 8]: a bit is set where the merged counter is at least `least`.

    Each task sends its nonzero counters, sparse, in chunks; a chunk is merged from its parts one by one, so a
    merging task holds one chunk of counters. The driver gets the bitmap only.
    """

    def partial(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            held.clear()
            for row in range(ROWS):
                at, n = np.unique(counters(keys, row), return_counts=True)
                chunk = (at >> np.uint64(CHUNK_BITS)).astype(np.int64)
                ids, first = np.unique(chunk, return_index=True)
                inside = (at & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32)
                n = np.minimum(n, TOP).astype(np.uint8)
                ends = [*first[1:], len(at)]
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(ids + (row << (WIDTH_BITS - CHUNK_BITS)), pa.int64()),
                    "at": pa.array([inside[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    "n": pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                })

        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size > 1 << 21:
                    yield from flush()
                    size = 0
        yield from flush()

    def bits(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([np.packbits(counts >= least).tobytes()], pa.binary())})

    def merge(batches):
        current, counts = None, None
        for batch in batches:
            for chunk, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != current:
                    if current is not None:
                        yield bits(current, counts)
                    current, counts = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
                where = np.frombuffer(at, dtype=np.uint32)
                counts[where] = np.minimum(counts[where].astype(np.uint16) + np.frombuffer(n, dtype=np.uint8), TOP)
        if current is not None:
            yield bits(current, counts)

    parts = source.mapInArrow(partial, "chunk long, at binary, n binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk long, bits binary")
    out = np.zeros((ROWS << (WIDTH_BITS - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), dtype=np.uint8)
    for row in merged.toLocalIterator():
        out[row[0]] = np.frombuffer(row[1], dtype=np.uint8)
    return out.reshape(ROWS, -1)


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether every counter of a key is set: true for each key counted often enough, and for some others."""
    found = np.ones(len(keys), dtype=bool)
    for row in range(ROWS):
        at = counters(keys, row)
        found &= (bitmap[row][at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return found
