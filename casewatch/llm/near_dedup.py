"""Near-duplicate classes by Order MinHash over five-word shingles, candidates verified by banded alignment.

Similarity of two texts: m / (a + b - m), with a and b their numbers of shingles and m the length of the longest
common subsequence of their shingle sequences (the Jaccard measure of shingles kept in order). Linked: 0.8 or more.

1. Texts with the same words form one group; only its smallest id goes on.
2. Order MinHash: each of TABLES hash functions ranks the occurrence-labelled shingles of a text of more than SHORT;
   the PICKED smallest, in text order, make the table's key. Texts that share a key are candidates. Shorter texts,
   and those up to SHORT / 0.8 that may be linked to one, have an exact prefix filter instead: of n shingles the
   n - ceil(0.8 n) + 1 rarest are keys of their own. Two linked texts have one of these in common, as each lacks
   at most n - ceil(0.8 n) of its shingles in the other and both rank by the same counts.
3. Candidates are checked against pivots (the member that shares buckets with most others), never all against
   all: a bucket of n texts gives at most n pairs a round. One step of merging after each round gives linked texts a
   common label. Buckets of three or more that still hold several labels go through further rounds with other pivots;
   at last all remaining pairs of members with different labels are checked, so no candidate link that could join two
   components is left out. Pairs whose shingle bitmaps already differ too much for the threshold never leave that join.
4. All links found are merged into components; every document gets the smallest id of its component as its class.

A linked pair with a text of at most SHORT shingles always shares a key. Of longer ones, m common of u shingles share
none with probability (1 - C(m, 8) / C(u, 8))**40: at the threshold at most 1.6e-3 (52 of 65), below 1e-3 from 160
shingles on and (1 - 0.8**8)**40 = 6e-4 in the limit; at a similarity of 0.85 below 2e-5.
Texts without words are never duplicates; texts of one to four words only of equal ones. Null ids get no class
(null). All rows are returned; rows that repeat an id with other texts are one document, which belongs to the class
with the smallest id that any of its texts is in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W
from casewatch.llm.components import closer, components

SHINGLE = 5
LEAST = 0.8
TABLES = 40
PICKED = 8
ROUNDS = 3
SHORT = 64
COUNTERS = 1 << 20  # of shingles of short texts by their hash; they only rank, so equal ones cost nothing but selectivity
BITS = 1024
_POWERS = W.powers(256)[0][:256].copy()
_ODD = (W.mix(np.arange(1, 257, dtype=np.uint64), 11) | np.uint64(1))


def shingles(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of each k consecutive 16-bit word codes."""
    return W.gram_hashes(W.prefix_sums(W.mix(codes.astype(np.uint64) + np.uint64(1))), k)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each value mixed with how many equal ones stand before it."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    fresh = np.ones(len(x), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return x
    at = np.arange(len(x))
    occurrence = np.zeros(len(x), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, W.mix(x + occurrence * np.uint64(0x9E3779B97F4A7C15)), x)


def order_keys(x: np.ndarray, tables: int = TABLES, picked: int = PICKED) -> np.ndarray:
    """Key of each table: the picked smallest labelled shingles under its hash, in text order."""
    marked, n = labelled(x), len(x)
    keys = np.zeros(tables, dtype=np.uint64)
    few = n > 8 * picked  # then only values below a bound that about 4 * picked pass are looked at
    bound = np.uint64(int((1 << 64) - 1) // n * 4 * picked) if few else None
    for t in range(tables):  # one row at a time: long texts stay in a small buffer
        ranked = marked * _ODD[t]
        some = np.flatnonzero(ranked < bound) if few else np.arange(n)
        if len(some) < min(picked, n):
            some = np.arange(n)
        at = some[np.argpartition(ranked[some], picked - 1)[:picked]] if len(some) > picked else some
        at.sort()
        keys[t] = marked[at] @ _POWERS[: len(at)]
    return W.mix(keys) + np.arange(tables, dtype=np.uint64)


def prefix_keys(x: np.ndarray, counts: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The rarest labelled shingles, so many that two texts of the similarity `least` have one in common."""
    marked, n = labelled(x), len(x)
    order = np.lexsort((marked, counts[marked % np.uint64(len(counts))]))
    return W.mix(marked[order[: n - math.ceil(least * n - 1e-9) + 1]], 41)


def needed(a: int, b: int, least: float) -> int:
    return math.ceil(least * (a + b) / (1 + least) - 1e-9)


def aligned(x: list, y: list, least: float = LEAST) -> float:
    """Similarity of two shingle sequences by alignment within the band that the threshold allows, 0.0 below it.

    Bit-parallel: one integer holds the state of a row. A common start and end are matched first.
    """
    a, b = len(x), len(y)
    need = needed(a, b, least)
    if min(a, b) < max(need, 1):
        return 0.0
    head = 0
    while head < min(a, b) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(a, b) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[head : a - tail], y[head : b - tail]
    common = head + tail
    if x and y:
        places: dict = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        if common + sum(v in places for v in x) < need:
            return 0.0
        width = max(a, b) - need + abs(a - b) + 1
        band, full = (1 << 2 * width + 1) - 1, (1 << len(y)) - 1
        state = full
        for i, v in enumerate(x):
            match = places.get(v, 0)
            if match:
                match &= band << i - width if i > width else band >> width - i
                hit = state & match
                state = (state + hit | state - hit) & full
        common += len(y) - state.bit_count()
    return common / (a + b - common) if common >= need else 0.0


def signatures(docs: DataFrame, tables: int, picked: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, same, same2, codes, keys, bins, node) of the documents with an id and words; `node` tells rows apart.

    Codes are 16-bit word hashes; keys are empty up to SHORT shingles; bins hold, for each of 1024 values of the hash's first
    bits, whether the number of such shingles is odd.
    """

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for low, high, data, offsets in W.slices(batch.column(1)):
                words = W.split(data, offsets)
                a, b = words.first[:-1], words.first[1:]
                same = W.run_hashes(W.prefix_sums(words.hashes), a, b)
                same2 = W.run_identities(W.mix(words.hashes, 5), a, b)
                codes = (words.hashes >> np.uint64(48)).astype("<u2")
                keys, bins, n = [], [], np.maximum(b - a - SHINGLE + 1, 0)
                for i, j in zip(a, b):
                    x = shingles(codes[i:j])
                    keys.append(order_keys(x, tables, picked) if len(x) > SHORT else np.zeros(0, dtype=np.uint64))
                    bins.append(np.packbits(np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).view(np.int64))
                at = np.flatnonzero(b > a)
                ends = np.cumsum([0, *(len(keys[i]) for i in at)])
                flat = np.concatenate([keys[i] for i in at]) if len(at) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[low:high].take(pa.array(at)), pa.array(n[at].astype(np.int32)), W.signed(same[at]), W.signed(same2[at]),
                    pa.array([codes[a[i] : b[i]].tobytes() for i in at], pa.binary()), W.lists(ends, W.signed(flat)),
                    W.lists(np.arange(len(at) + 1) * (BITS // 64), pa.array(np.concatenate([bins[i] for i in at]) if len(at) else np.zeros(0, dtype=np.int64))),
                ], ["doc_id", "n", "same", "same2", "codes", "keys", "bins"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = source.mapInArrow(run, "doc_id long, n int, same long, same2 long, codes binary, keys array<long>, bins array<long>")
    return made.withColumn("node", F.monotonically_increasing_id())


def short_keys(table: DataFrame, least: float) -> DataFrame:
    """(node, n, key) of the texts that are short or may be linked to a short one; the driver gets COUNTERS counts."""
    short = table.where(F.col("n").between(1, int(SHORT / least + 1e-9))).select("node", "n", "codes")

    def count(batches):
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            found = [labelled(shingles(np.frombuffer(c, dtype="<u2"))) for c in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["counter", "size"])

    totals = short.select("codes").mapInArrow(count, "counter long, size long").groupBy("counter").agg(F.sum("size").alias("size")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[totals.column(0).to_numpy()] = totals.column(1).to_numpy()
    shared = table.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            found = [prefix_keys(shingles(np.frombuffer(c, dtype="<u2")), shared.value, least) for c in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            keys = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), W.signed(keys)], ["node", "n", "key"])

    return short.mapInArrow(run, "node long, n int, key long")


def verified(pairs: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are linked."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                one, two = (shingles(np.frombuffer(c, dtype="<u2")).tolist() for c in (x, y))
                if (s := aligned(one, two, least)) >= least:
                    for values, v in zip(out, (a, b, s)):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    one = codes.select(F.col("node").alias("a"), F.col("codes").alias("x"))
    two = codes.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def _close(one: str, two: str, least: float):
    """Numbers of shingles that allow the threshold at all."""
    return F.least(F.col(one), F.col(two)) >= F.lit(least) * F.greatest(F.col(one), F.col(two)) - F.lit(1e-9)


def _may_overlap(least: float):
    """Whether the bins allow the threshold: each bin that differs holds a shingle that is not in common."""
    apart = sum((F.bit_count(F.col("bins")[i].bitwiseXOR(F.col("other_bins")[i])) for i in range(BITS // 64)), F.lit(0))
    return apart <= (F.col("n") + F.col("pn")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members with the smallest node that they are known to be linked to."""
    if links is None:
        return members.withColumn("label", F.col("node"))
    named = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return members.join(named, "node", "left").withColumn("label", F.least(F.coalesce("label", "node"), "node"))


def _rank(turn: int):
    """Order of the members of a bucket; the first is its pivot.

    The source of many copies shares more keys with them than they with each other, so it comes first; later
    rounds weigh by a random factor, to try others.
    """
    chance = F.lit(1.0) if turn == 0 else (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) + 1) / (1 << 20)
    return F.struct(
        (-F.col("company") * chance).alias("r"), F.xxhash64("node", F.lit(turn)).alias("h"),
        F.col("node").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"),
    )


def near_duplicates(
    docs: DataFrame, least: float = LEAST, tables: int = TABLES, picked: int = PICKED, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id) of every row of `docs`; class_id is the smallest id of the document's class."""
    spark = docs.sparkSession
    W.small_batches(spark)
    table = W.stored(signatures(docs, tables, picked, id_col, text_col), "signatures")
    groups = table.groupBy("same", "same2").agg(F.min("node").alias("node"))
    first = W.stored(table.drop("node").join(groups, ["same", "same2"]).select("doc_id", "node").distinct(), "heads")
    buckets = table.select("node", "n", F.explode("keys").alias("key")).unionByName(short_keys(table, least))
    kept = buckets.join(groups.select("node"), "node", "left_semi").distinct()
    sizes = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = W.stored(kept.join(sizes, "key"), "shared")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    members = W.stored(shared.drop("size").join(company, "node"), "members")
    # codes of candidates only, once; later rounds read this small table
    codes = W.stored(table.select("node", "codes", "bins").join(company.select("node"), "node"), "codes")

    links = None
    for turn in range(rounds + 1):
        named = _labelled(members, links)
        mixed = named.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.min(_rank(turn)).alias("pivot")
        ).where("low < high")
        if turn > 0:  # two members have met in the first round
            mixed = mixed.where("size > 2")
        if turn < rounds:
            pairs = named.join(mixed.select("key", "pivot.p", "pivot.pn", "pivot.pl"), "key").where("label <> pl").where(_close("n", "pn", least))
        else:  # what is left: members of different labels in one bucket
            open_ = W.stored(named.join(mixed.select("key"), "key").join(codes.select("node", "bins"), "node"), "open")
            other = open_.select("key", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"), F.col("bins").alias("other_bins"))
            pairs = open_.join(other, "key").where("label < pl").where(_close("n", "pn", least)).where(_may_overlap(least))
        pairs = pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        pairs, met = W.stored_with(pairs, "pairs", n=F.count(F.lit(1)))
        if met["n"] == 0:
            continue
        found, linked = W.stored_with(verified(pairs, codes, least).select("a", "b"), "links", n=F.count(F.lit(1)))
        if linked["n"] == 0:
            continue
        found = found if links is None else links.unionByName(found)
        links = closer(found)[0] if turn < rounds else found
    classes = first
    if links is not None:
        labels = components(links).withColumnRenamed("a", "node")
        classes = first.join(labels, "node", "left").select("doc_id", F.coalesce("b", "node").alias("node"))
    smallest = classes.groupBy("node").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(smallest, "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
