"""Removal of word passages that an earlier document already has, with a count-min prefilter.

A window is WINDOW consecutive words of one document; a word goes if a window over it also starts in a document
with a smaller id. Windows are judged on the input.

1. Each window's key is the smallest hash of its 25-word grams. Equal windows have equal keys, so counting runs
   of windows with one key (blocks), once each, overestimates how often any of their windows occurs. Tasks count
   keys in count-min sketches that Spark merges.
2. Only documents holding a block whose key is estimated repeated go on, with their text. Equal blocks are
   grouped exactly (128-bit identity); all occurrences but those in the smallest document are removed whole.
   Where a key has several different blocks, the windows of each block's first occurrence are grouped exactly.
Nothing repeated is lost: a repeated window's key is counted at least twice. Hot blocks are combined before the
shuffle by min(), and the joins back are plain equi-joins that AQE splits.

Null or empty text has no words. Documents with a null id neither lose words nor make others lose them; rows
that repeat an id do not take words from each other. Long documents are handled one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import sketch
from casewatch.llm import words as W

WINDOW = 50
_BLOCK = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("block", pa.int64())])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_keys(words: W.Words, sums: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, key) of each window that lies within a document."""
    count = len(words.hashes) - window + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = (window + 1) // 2
    keys = _least(W.gram_hashes(sums, gram), window - gram + 1)
    at = np.flatnonzero(np.arange(count) + window <= words.until()[:count])
    return at, keys[at]


def _blocks(words: W.Words, sums: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, key, identity) of the runs of windows with one key."""
    at, keys = window_keys(words, sums, window)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    n = np.diff([*first, len(at)])
    start = at[first]
    identity = W.run_identities(words.hashes, start, start + n + window - 1) ^ W.mix(n.astype(np.uint64), 7)
    return start, n, keys[first], identity


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def estimate(docs: DataFrame, window: int) -> np.ndarray:
    def keys_of(batch):
        known = batch.filter(batch.column(0).is_valid())
        for _, _, data, offsets in W.slices(known.column(1)):
            words = W.split(data, offsets)
            yield _blocks(words, W.prefix_sums(words.hashes), window)[2]

    return sketch.repeated_keys(docs, keys_of)


def candidates(docs: DataFrame, bitmap: np.ndarray, window: int) -> DataFrame:
    """Every document with a row id; text and blocks only where a key is estimated repeated.

    Columns after doc_id and text are passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    more = docs.columns[2:]

    def run(batches):
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            for low, high, data, offsets in W.slices(batch.column(1)):
                words = W.split(data, offsets)
                start, n, key, identity = _blocks(words, W.prefix_sums(words.hashes), window)
                doc = np.searchsorted(words.first, start, side="right") - 1
                keep = sketch.holds(shared.value, key) & valid[low:high][doc]
                start, n, key, identity, doc = (x[keep] for x in (start, n, key, identity, doc))
                held = np.zeros(high - low, dtype=bool)
                held[doc] = True
                raw = data.tobytes()
                kept = [None if held[i] else kept_digest(raw[offsets[i] : offsets[i + 1]].split()) for i in range(high - low)]
                blocks = pa.StructArray.from_arrays(
                    [pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), W.signed(key), W.signed(identity)],
                    fields=list(_BLOCK),
                )
                yield pa.RecordBatch.from_arrays([
                    pa.array(row_id + np.arange(high - low)), batch.column(0)[low:high], pa.array(np.diff(words.first)),
                    batch.column(1)[low:high], pa.array(kept, pa.string()),
                    W.lists(np.searchsorted(doc, np.arange(high - low + 1)), blocks),
                    *(batch.column(i)[low:high] for i in range(2, 2 + len(more))),
                ], ["row_id", "doc_id", "n_words", "text", "kept_sha256", "blocks", *more])
                row_id += high - low

    types = "".join(f", `{n}` {t}" for n, t in docs.dtypes[2:])
    return docs.mapInArrow(run, f"row_id long, doc_id long, n_words long, text string, kept_sha256 string, blocks array<struct<start:int,n:int,key:long,block:long>>{types}")


def kept_digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _windows(first_blocks: DataFrame, window: int) -> DataFrame:
    """(row_id, doc_id, start, key, hash) of each window of the listed blocks of each document."""

    def run(batches):
        for batch in batches:
            spans = batch.column(3).to_pylist()
            for low, high, data, offsets in W.slices(batch.column(2)):
                words = W.split(data, offsets)
                sums = W.prefix_sums(words.hashes)
                rows, starts, keys = [], [], []
                for i in range(low, high):
                    for s in spans[i]:
                        rows.append(np.full(s["n"], i))
                        starts.append(np.arange(s["start"], s["start"] + s["n"]))
                        keys.append(np.full(s["n"], s["key"]))
                row, start, key = (np.concatenate(x) for x in (rows, starts, keys))
                at = words.first[row - low] + start
                hashes = W.mix(W.run_hashes(sums, at, at + window), 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(key), W.signed(hashes)],
                    ["row_id", "doc_id", "start", "key", "hash"],
                )

    return first_blocks.mapInArrow(run, "row_id long, doc_id long, start int, key long, hash long")


def find_repeats(docs: DataFrame, window: int, id_col: str, text_col: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidate table, removals): removals are (row_id, spans array<struct<start, n>>), n windows from a start word.

    The table keeps the text of candidates only, unless `whole`, which also keeps all columns as c0, c1, ...
    """
    W.small_batches(docs.sparkSession)
    bitmap = estimate(_narrow(docs, id_col, text_col), window)
    more = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col] if whole else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    table = candidates(source, bitmap, window)
    if not whole:
        table = table.withColumn("text", F.when(F.size("blocks") > 0, F.col("text")))
    table = W.stored(table, "passages")
    blocks = table.where(F.size("blocks") > 0).select("row_id", "doc_id", F.inline("blocks"))
    grouped = blocks.groupBy("key", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    keys = grouped.groupBy("key").agg(
        (F.count(F.lit(1)) > 1).alias("several"), (F.min("first_doc") < F.max("last_doc")).alias("shared")
    ).where("shared")
    judged = grouped.join(keys, "key").select("key", "block", "first_doc", "several")
    found = W.stored(
        blocks.join(judged, ["key", "block"])
        .where("doc_id > first_doc or several")
        .select("row_id", "doc_id", "start", "n", "key", (F.col("doc_id") > F.col("first_doc")).alias("later")),
        "blocks",
    )
    first_blocks = found.where("not later").groupBy("row_id").agg(F.collect_list(F.struct("start", "n", "key")).alias("spans"))
    windows = W.stored(
        _windows(table.join(first_blocks, "row_id").select("row_id", "doc_id", "text", "spans"), window), "windows"
    )
    firsts = (
        windows.groupBy("key", "hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc").select("key", "hash", "first_doc")
    )
    later = windows.join(firsts, ["key", "hash"]).where("doc_id > first_doc").select("row_id", "start", F.lit(1).alias("n"))
    removed = found.where("later").select("row_id", "start", "n").unionByName(later)
    return table, removed.groupBy("row_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _kept(words: list[bytes], spans: list, window: int) -> list[bytes]:
    border = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans or ():
        border[s["start"]] += 1
        border[s["start"] + s["n"] + window - 1] -= 1
    covered = np.cumsum(border[:-1]) > 0
    return [w for w, c in zip(words, covered) if not c]


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    table, removals = find_repeats(docs, window, id_col, text_col)

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                left = _kept(words, spans, window)
                removed.append(len(words) - len(left))
                kept.append(kept_digest(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    touched = table.where(F.col("text").isNotNull()).join(removals, "row_id", "left").select("doc_id", "n_words", "text", "spans")
    untouched = table.where(F.col("text").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return untouched.unionByName(touched.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def cleaned(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`; where words go, the text is the words left, joined by one space.

    A column n_chars, where there is one, follows the text.
    """
    table, removals = find_repeats(docs, window, id_col, text_col, whole=True)

    def run(batches):
        for batch in batches:
            texts = [b" ".join(_kept(t.encode().split(), s, window)).decode() for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *names])

    names = [f"c{k}" for k, c in enumerate(docs.columns) if c != text_col]
    types = "".join(f", `{n}` {t}" for n, t in table.select(*names).dtypes)
    # only candidates meet the removals; the others go straight to the result
    some = table.where(F.size("blocks") > 0).join(removals, "row_id", "left")
    changed = some.where("spans is not null").select("text", "spans", *names).mapInArrow(run, f"text string{types}").withColumn("changed", F.lit(True))
    same = some.where("spans is null").unionByName(table.where(F.size("blocks") == 0), allowMissingColumns=True)
    out = changed.unionByName(same.select("text", *names, F.lit(False).alias("changed")))

    def column(k: int, c: str):
        if c == text_col:
            return F.col("text").alias(c)
        if c == "n_chars":
            return F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"c{k}")).alias(c)
        return F.col(f"c{k}").alias(c)

    return out.select(*(column(k, c) for k, c in enumerate(docs.columns)))
