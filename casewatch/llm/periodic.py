"""Runs of repeated words (periodic stretches) found with a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least `exponent` * q and `least` words long, that no
neighbouring word extends keeping the period.

Method, for each text apart: every stretch of 1, 2, 4, ... words gets a name, equal for equal stretches (the name of
2m words is made of the names of both halves; the first names are the words themselves, so no hash decides). At a
length m, the next occurrence of a stretch is looked at if it starts m / 2 to m words on, so that both lie within 2m
words; such occurrences form arithmetic progressions, whose difference d is proposed as a period. Neighbouring starts
that propose the same d are one stretch, extended over all of them: starts a to b give the words a to b + m + d - 1.

Why this gives every run once. In a run of period q >= 1 and length >= 3q take the m with q <= m < 2q. Every start
that leaves room for m + q words has its next occurrence exactly q words on (a nearer one would give a smaller
period), and there is such a start as m + q < 3q. The words beyond the run break the progression, so the extended
stretch is the run, and as d lies in one interval (m / 2, m] only, no other length proposes it again. Conversely the
smallest period of an extended stretch is d, since a smaller one would be the distance of a nearer occurrence.

Names without a second occurrence in their text are dropped before the next length, so a text without repeats costs
little more than its words. All texts of a slice are worked on together; memory follows the longest text. There is
no shuffle.

Null text counts as empty and has no runs; rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W

LEAST = 24
EXPONENT = 3
PART = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BETWEEN = re.compile(rb"[\x20\x09-\x0D]")


def numbered(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers of `known`, which grows by new words; long texts are split in parts."""
    parts, at = [], 0
    while at < len(raw):
        border = _BETWEEN.search(raw, at + PART)
        end = border.start() if border else len(raw)
        found = raw[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int64, count=len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose key occurs again, their names from 0)."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[names] > 1)
    return again, names[again]


def find_runs(numbers: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the texts numbers[first[i]:first[i + 1]].

    Starts count from the beginning of `numbers`. The exponent must be 3 or more.
    """
    if exponent < 3:
        raise ValueError("runs shorter than three periods may have no progression of the length that proposes them")
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    width = int(numbers.max()) + 1 if len(numbers) else 1
    at, names = _named(text * width + numbers)
    longest = int(sizes.max()) if len(sizes) else 0
    whole = np.full(len(numbers) + 1, -1, dtype=np.int64)  # name of the stretch that starts at each word
    found, m = [], 1
    while len(at) and m // 2 < longest // exponent:
        order = np.argsort(names, kind="stable")  # places stay ascending within a name
        gap = np.zeros(len(at), dtype=np.int64)
        same = names[order[1:]] == names[order[:-1]]
        gap[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        near = np.flatnonzero((gap > m // 2) & (gap <= m))
        if len(near):
            place, d = at[near], gap[near]
            breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(d) != 0)) + 1
            low, high = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(place)]]) - 1
            d, start = d[low], place[low]
            length = place[high] - start + m + d
            long_ = length >= np.maximum(least, exponent * d)
            found.append(np.stack([start, length, d], axis=1)[long_])
        whole[at] = names
        beyond = np.minimum(at + m, len(numbers))
        second = whole[beyond]
        both = np.flatnonzero((second >= 0) & (text[np.minimum(beyond, len(text) - 1)] == text[at]))
        keys = names[both] * (int(names.max()) + 1) + second[both]
        whole[at] = -1
        again, names = _named(keys)
        at, m = at[both[again]], 2 * m
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def left_over(n: int, runs: np.ndarray) -> np.ndarray:
    """The words that no run contains after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(depth)[:n] == 0)


def _joined(numbers: np.ndarray, words: list[bytes]) -> bytes:
    parts = (numbers[i : i + PART].tolist() for i in range(0, len(numbers), PART))
    return b" ".join(b" ".join(map(words.__getitem__, p)) for p in parts)


def periodic_runs(
    docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, order: Callable[[int | None, int], np.ndarray | None] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and the words that are left
    when each run keeps its first period only, joined by one space.

    `order(doc_id, n)` may give the word numbers to read in place of 0 to n - 1; None leaves the text as it is.
    """
    W.small_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(1)):
                raw, known, texts = data.tobytes(), {}, []
                ids = batch.column(0)[low:high]
                for doc_id, a, b in zip(ids.to_pylist(), offsets, offsets[1:]):
                    numbers = numbered(raw[a:b], known)
                    places = order(doc_id, len(numbers)) if order else None
                    texts.append(numbers if places is None else numbers[places])
                first = np.cumsum([0, *map(len, texts)])
                runs = find_runs(np.concatenate(texts), first, least, exponent)
                cut = np.searchsorted(runs[:, 0], first)
                runs[:, 0] -= np.repeat(first[:-1], np.diff(cut))
                words = list(known)
                collapsed = []
                for i, numbers in enumerate(texts):
                    own = runs[cut[i] : cut[i + 1]]
                    collapsed.append(_joined(numbers[left_over(len(numbers), own)] if len(own) else numbers, words))
                listed = pa.StructArray.from_arrays([pa.array(runs[:, k].copy()) for k in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(first)), W.lists(cut, listed), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def strongest(runs):
    """The run with the greatest exact length / period; of equal ones the first of the list. Null for no run."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
