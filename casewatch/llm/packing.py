"""Best-fit packing of pieces into sequences of a fixed capacity by exact-complement hashing.

Only the number of pieces of each length matters for the plan, so Spark counts lengths (at most `capacity`
values), the driver plans patterns of lengths with a multiplicity each, and Spark deals every piece to a place:
its rank among pieces of its length selects the pattern, the sequence and the offset. The plan's size is bounded
by the capacity, not by the data. Ranks are made per (length, salt), so that one length may hold any share of
all rows without filling one task.

Plan: the longest remaining length opens a sequence; its gap is filled by one length, a pair or a triple whose
sum is exactly the gap, found in indexes of single, pair and triple sums of the lengths still available, under
their counts. Where there is none, the longest length that fits goes in (best fit) and the rest of the gap is
tried again. A pattern is used as often as its counts allow.

Null or empty text gives one piece holding only the end id. Repeated rows are packed each; an empty table gives
no rows. Null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.llm import bpe
from casewatch.llm import words as W

CAPACITY = 2048
_RANK_BITS = 48


class _Sums:
    """Which lengths, and sums of two lengths, are available; rebuilt only when a length runs out."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, len(counts)
        self.refresh()

    def refresh(self) -> None:
        self.single = self.counts > 0
        self.lengths = np.flatnonzero(self.single)[::-1]
        mask = self.single.astype(np.float32)
        n = 1 << (2 * self.size - 1).bit_length()
        self.pair = np.rint(np.fft.irfft(np.fft.rfft(mask, n) ** 2, n))[: self.size] > 0

    def find_pair(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of that sum, the longest first, that the counts still allow next to those held."""
        if total < 2 or not self.pair[total]:
            return None
        small = np.arange(1, total // 2 + 1)
        for x in small[self.single[small] & self.single[total - small]]:
            found = (total - int(x), int(x))
            if self.allowed((*held, *found)):
                return found
        return None

    def allowed(self, pattern: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= pattern.count(x) for x in set(pattern))

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        if self.single[gap] and self.allowed((*held, gap)):
            return (gap,)
        if found := self.find_pair(gap, held):
            return found
        third = self.lengths[self.lengths < gap - 1]
        for z in third[self.pair[gap - third]]:
            if self.allowed((*held, int(z))) and (found := self.find_pair(gap - int(z), (*held, int(z)))):
                return (int(z), *found)
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, number of such sequences)] holding every counted piece once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    sums, patterns = _Sums(counts), []
    while len(sums.lengths):
        pattern: tuple[int, ...] = (int(sums.lengths[0]),)
        gap = capacity - pattern[0]
        while gap:
            if found := sums.exact(gap, pattern):
                pattern, gap = (*pattern, *found), 0
                continue
            fitting = next((int(x) for x in sums.lengths[sums.lengths <= gap] if sums.allowed((*pattern, int(x)))), 0)
            if not fitting:
                break
            # several pieces of that length at once, so that tiny lengths take few steps
            times = max(1, min(gap // fitting, int(counts[fitting]) - pattern.count(fitting)) // 2)
            pattern, gap = (*pattern, *[fitting] * times), gap - fitting * times
        used = {x: pattern.count(x) for x in set(pattern)}
        times = min(int(counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
        patterns.append((pattern, times))
        if any(counts[x] == 0 for x in used):
            sums.refresh()
    return patterns


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of (length, rank): key of the range's start, its first sequence, its offset."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            rows.append(((length << _RANK_BITS) + rank, sequence, offset))
            next_rank[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    key, first, offset = (np.array(x, dtype=np.int64) for x in (zip(*rows) if rows else ((), (), ())))
    return key, first, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a `length` of 1 to `capacity`; other columns are kept.

    `pieces` should be stored: it is read three times and must give the same rows each time.
    """
    spark = pieces.sparkSession
    counted = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    key, first, offset = _places(plan(counted, capacity))
    shared = spark.sparkContext.broadcast((key, first, offset))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = {x: W.fresh_name(pieces, x) for x in ("salt", "local", "base", "n")}
    salted = pieces.withColumn(names["salt"], F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)))
    group = ["length", names["salt"]]
    bases = (
        salted.groupBy(*group).agg(F.count(F.lit(1)).alias(names["n"]))
        .withColumn(names["base"], F.sum(names["n"]).over(Window.partitionBy("length").orderBy(names["salt"])) - F.col(names["n"]))
        .drop(names["n"])
    )
    ranked = salted.withColumn(
        names["local"], F.row_number().over(Window.partitionBy(*group).orderBy(*pieces.columns)) - F.lit(1)
    ).join(bases, group)
    ranked = ranked.select(*pieces.columns, (F.col(names["base"]) + F.col(names["local"])).alias(names["local"]))
    names_out, width = [*pieces.columns, "sequence_id", "offset"], len(pieces.columns)
    length_at = pieces.columns.index("length")

    def place(batches):
        starts, sequences, offsets = shared.value
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = (length << _RANK_BITS) + batch.column(width).to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, wanted, side="right") - 1
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(sequences[at] + wanted - starts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    types = [(f.name, f.dataType.simpleString()) for f in pieces.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*types, ("sequence_id", "bigint"), ("offset", "bigint")])
    return ranked.mapInArrow(place, schema)


def document_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, row) of whole documents, tokenized, cut and written; `row` tells rows apart."""
    pieces = bpe.token_pieces(docs, vocabulary_path, capacity)
    return W.stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, keep: dict[str, Column] | None = None) -> DataFrame:
    """Places of the pieces of whole documents: (doc_id, piece, start, length, `keep`, sequence_id, offset).

    `keep` names columns made from those of `document_pieces`. The ids stay in the written pieces, so
    only a few numbers a piece are shuffled.
    """
    pieces = document_pieces(docs, vocabulary_path, capacity)
    more = [column.alias(name) for name, column in (keep or {}).items()]
    return pack(pieces.select("doc_id", "piece", "start", "length", *more), capacity)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, ids, pieces): what a training run reads, from the written `document_pieces`.

    `ids` are the ids of all pieces in order, unsigned 32-bit little-endian; `pieces` (offset, length, doc_id, piece) say
    where each begins. The ids are shuffled once to their places and once to their sequences; a sequence has at most
    `capacity` ids, so no group is large.
    """
    placed = pack(pieces.drop("ids"), capacity).join(pieces.select("row", "ids"), "row")
    entry = F.struct("offset", "length", "doc_id", "piece", "ids")
    held = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(entry)).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda ids, e: F.concat(ids, e["ids"]))
    places = F.transform("held", lambda e: F.struct(e["offset"], e["length"], e["doc_id"], e["piece"]))
    return held.select("sequence_id", "length", joined.alias("ids"), places.alias("pieces"))
