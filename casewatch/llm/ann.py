"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table has two hashes. Each rotates unit vectors by three rounds of random signs and a fast Hadamard transform; the nearest
signed axis is its value, both together name a cell. Every distinct vector is indexed once in each of
TABLES tables; a query looks into the cells of the table whose two axes have the largest summed components.
Vectors of the cells are scored exactly in double precision, and each query's best lists are merged.

Where norms differ, entries are split into zones of norm (each up to sqrt(2) times its shortest) with buckets of their
own, in which the largest inner products have about the smallest angles; queries probe all zones. One rule gives the share
of a zone's cells that a query looks into, without a step at any size: SHARE at 200,000 entries, falling with the
fourth root of their number (near ones get nearer), plus what holds about SMALL entries, and never below PROBES cells. So
few very long vectors are found by all queries and change nothing for the others. What that share finds depends on the
width and on how near the nearest are, so recall is measured: SAMPLE queries (the smallest hashes of distinct ones) are
scored against all entries, and a zone's number of cells is raised to what finds RECALL of their best, up to all cells. A
query that finds fewer than k others is scored against all entries, by all slices of one table, in which each entry is once.

Equal vectors are one entry that carries its smallest k + 1 ids, which is all that a result of k can show. The cells of a
table are dealt to slices of about BLOCK entries; a slice of more than twice as many (near vectors share cells) is split
by the entries' hash. Queries go to the slices that hold their cells, with a list of these; where a zone is one slice or
the list would have more than LISTED cells, they go to all its slices, and the tasks there take the entries whose cells reach
the summed components that as many cells reach. A task holds one part and streams queries past it.

Null and zero vectors and those with null or non-finite components take no part. Shorter vectors count as filled
with zeros. Rows that repeat an id and vector count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import vectors as V
from casewatch.llm import words as W

TABLES = 10
PROBES = 12
LISTED = 1024  # longer lists of cells are not sent: the query goes to all slices instead
SHARE = 0.01
SAMPLE, RECALL = 64, 0.96
BLOCK = 8192
SMALL = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def turned(x: np.ndarray, table: int, number: int) -> np.ndarray:
    """Components of each row along the signed axes of one hash of a table; negative axes follow the positive ones."""
    signs = np.random.default_rng([7, table, number]).integers(0, 2, (3, x.shape[1])) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def cells(x: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (first axis, second axis) of each row with the largest summed components, largest first: rows x probes."""
    both = [turned(x, table, number) for number in (0, 1)]
    some = min(probes, both[0].shape[1])  # a cell among the first `probes` has no axis beyond them
    near = [np.argsort(-b, axis=1, kind="stable")[:, :some] for b in both]
    part = [np.take_along_axis(b, n, axis=1) for b, n in zip(both, near)]
    probes = min(probes, some * some)
    rank = np.arange(1, some + 1)
    first, second = np.nonzero(rank[:, None] * rank <= probes)  # rank * rank - 1 other cells are no smaller than a cell
    total = part[0][:, first] + part[1][:, second]
    best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(total, best, axis=1), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(near[0], first[best], axis=1), np.take_along_axis(near[1], second[best], axis=1)


def least_sum(a: np.ndarray, b: np.ndarray, probes: int) -> float:
    """A sum of a component of `a` and one of `b` that at least `probes` cells reach, and hardly more."""
    b = np.sort(b)
    low, high = a.min() + b[0], a.max() + b[-1]
    for _ in range(24):
        middle = 0.5 * (low + high)
        enough = (len(b) - np.searchsorted(b, middle - a)).sum() >= probes
        low, high = (middle, high) if enough else (low, middle)
    return low


def probed_cells(n: int, signed: int, share: float = SHARE, small_zone: int = SMALL) -> int:
    """Cells of each table that a query looks into at least in a zone of n entries."""
    whole = signed * signed
    return min(whole, max(PROBES, int(whole * (share * (200_000 / n) ** 0.25 + small_zone / n))))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit rows of a power-of-two width."""
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    width = 1 << max(x.shape[1] - 1, 1).bit_length()
    return np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], axis=1)


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids): distinct vectors with their k + 1 smallest ids; tasks combine equal ones first."""

    def combine(batches):
        for batch in batches:
            held: dict[bytes, list] = {}
            for i, (vec_id, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                held.setdefault(np.array(v).tobytes(), [i, set()])[1].add(vec_id)
            at = pa.array([h[0] for h in held.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), pa.array([sorted(h[1])[: k + 1] for h in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    some = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).mapInArrow(combine, "v array<double>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return some.groupBy("v").agg(ids.alias("ids")).select(F.xxhash64("v").alias("entry"), "v", "ids")


def _needed_cells(entries: DataFrame, asked: DataFrame, k: int, width: int, tables: int) -> dict[int, int]:
    """Cells of each table that find RECALL of the k best of SAMPLE queries, by zone; the sample is scored against all entries."""
    sample = asked.select("entry", "v").orderBy("entry").limit(SAMPLE).toArrow().combine_chunks()
    if sample.num_rows == 0:
        return {}
    names, q = sample["entry"].to_numpy(), V.matrix(sample["v"].chunk(0), width)

    def scored(batches):
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in names]
        for batch in batches:
            entry, scores = batch.column(0).to_numpy(), V.matrix(batch.column(1), width) @ q.T
            for i, (ids, best) in enumerate(held):
                ids, best = np.concatenate([ids, entry]), np.concatenate([best, scores[:, i]])
                keep = V.best(best, ids, k + 1)
                held[i] = ids[keep], best[keep]
        lists = [pa.array([h[c].tobytes() for h in held], pa.binary()) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(names), *lists], ["entry", "ids", "scores"])

    parts = entries.select("entry", "v").mapInArrow(scored, "entry long, ids binary, scores binary")
    at = {name: i for i, name in enumerate(names.tolist())}
    wanted: dict[int, list] = {}  # at most SAMPLE x k pairs
    for name, ids in V.merge_best(parts, "entry", k + 1, "float64").select("entry", "ids").collect():
        for e in [e for e in np.frombuffer(ids, dtype=np.int64).tolist() if e != name][:k]:
            wanted.setdefault(e, []).append(at[name])

    def ranked(batches):
        for batch in batches:
            x, entry = directions(V.matrix(batch.column(1), width)), batch.column(0).to_pylist()
            pairs = [(row, i) for row, e in enumerate(entry) for i in wanted.get(e, ())]
            cells_needed = np.full(len(pairs), np.iinfo(np.int64).max)
            for t in range(tables):
                first, second = cells(x, t, 1)
                a, b = (turned(directions(q), t, number) for number in (0, 1))
                ordered = np.sort(b, axis=1)
                for n, (row, i) in enumerate(pairs):
                    above = a[i, first[row, 0]] + b[i, second[row, 0]] - a[i]
                    larger = (b.shape[1] - np.searchsorted(ordered[i], above, side="right")).sum()
                    cells_needed[n] = min(cells_needed[n], larger + 1)
            zones = batch.column(2).take(pa.array([row for row, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([zones, pa.array(cells_needed)], ["zone", "cells"])

    theirs = entries.sparkSession.createDataFrame([(e,) for e in wanted], "entry long").hint("broadcast")
    needed = entries.join(theirs, "entry", "left_semi").select("entry", "v", "zone").mapInArrow(ranked, "zone int, cells long").toArrow()
    zone, cells_needed = needed["zone"].to_numpy(), needed["cells"].to_numpy()
    return {int(z): int(np.quantile(cells_needed[zone == z], RECALL, method="higher")) for z in np.unique(zone)}


def nearest(
    df: DataFrame, is_query, k: int = 20, tables: int = TABLES, share: float = SHARE, block: int = BLOCK, small_zone: int = SMALL,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row for which is_query(id column) holds."""
    spark = df.sparkSession
    W.small_batches(spark, 4000)
    rows = V.usable(df, id_col, vector_col, zero=False)
    entries = W.stored(_entries(rows, k), "entries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    width, least, most = entries.agg(F.max(F.size("v")), F.min(square), F.max(square)).first()
    queries = rows.where(is_query(F.col("vec_id"))).select("vec_id", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0))).alias("entry")).distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    differ = least < most * (1 - 1e-3)
    zone = F.coalesce(F.floor(F.log2(square)).cast("int"), F.lit(-2000)) if differ else F.lit(0)
    entries = entries.withColumn("zone", zone)
    counts = dict(entries.groupBy("zone").count().collect())  # some 2,000 zones at most
    signed = 2 * directions(np.ones((1, width))).shape[1]
    whole = signed * signed
    asked = entries.join(queries.select("entry").distinct(), "entry", "left_semi")
    needed = _needed_cells(entries, asked, k, width, tables)
    probes = {z: min(whole, max(probed_cells(c, signed, share, small_zone), needed.get(z, 0))) for z, c in counts.items()}
    slices = {z: min(whole, -(-c // block)) for z, c in counts.items()}
    listed = {z: slices[z] > 1 and probes[z] <= LISTED for z in counts}
    shipped = max((p for z, p in probes.items() if listed[z]), default=0)

    def index(batches):
        for batch in batches:
            x = directions(V.matrix(batch.column(1), width))
            own = [cells(x, t, 1) for t in range(tables)]
            cell = np.concatenate([a[:, 0] * signed + b[:, 0] for a, b in own])
            table, at = np.repeat(np.arange(tables), len(x)), np.tile(np.arange(len(x)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), pa.array(cell), *(batch.column(i).take(pa.array(at)) for i in range(4))], ["table", "cell", "entry", "v", "ids", "zone"])

    def probe(batches):
        for batch in batches:
            x = directions(V.matrix(batch.column(1), width))
            step = max(1, min(64, (1 << 19) // max(shipped, 1)))
            for lo in range(0, len(x), step):  # a row for each table, with the query's cells
                some = x[lo : lo + step]
                for t in range(tables):
                    a, b = cells(some, t, shipped) if shipped else (np.zeros((len(some), 0), dtype=np.int64),) * 2
                    lists = W.lists(np.arange(len(some) + 1) * a.shape[1], pa.array((a * signed + b).ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo : lo + step] for i in (0, 1)), pa.array(np.full(len(some), t, dtype=np.int32)), lists], ["entry", "v", "table", "cells"])

    # where all cells are looked into, one table holds all there is to find
    layout = [(z, t, slices[z], probes[z], listed[z]) for z in counts for t in range(tables if probes[z] < whole else 1)]
    layout = F.broadcast(spark.createDataFrame(layout, "zone int, table int, slices long, probes int, listed boolean"))  # at most zones x tables rows
    placed = entries.select("entry", "v", "ids", "zone").mapInArrow(index, "table int, cell long, entry long, v array<double>, ids array<long>, zone int")
    placed = placed.join(layout, ["zone", "table"]).withColumn("slice", F.col("cell") % F.col("slices"))
    large = ["zone", "table", "slice"]
    heavy = placed.groupBy(*large).agg(F.count("*").alias("n")).where(F.col("n") > 2 * block).select(*large, F.ceil(F.col("n") / block).alias("splits"))
    heavy = W.stored(heavy, "heavy")
    place = [*large, "part"]
    splits = F.coalesce("splits", F.lit(1))
    held = placed.join(heavy, large, "left").select(*large, F.pmod("entry", splits).alias("part"), F.lit(0).alias("side"), "entry", "v", "ids", F.array("cell").alias("cells"), "probes")

    def sent(probes_: DataFrame) -> DataFrame:
        """Copies of the queries for the parts that hold their cells; null cells are found there, `probes` of them."""
        every = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
        wanted = F.when(F.col("cells").isNull(), every).otherwise(F.array_distinct(F.transform("cells", lambda x: x % F.col("slices"))))
        some = probes_.withColumn("slice", F.explode(wanted)).withColumn("cells", F.filter("cells", lambda x: x % F.col("slices") == F.col("slice")))
        part = F.explode(F.sequence(F.lit(0).cast("long"), splits - 1)).alias("part")
        return some.join(heavy, large, "left").select(*large, part, F.lit(1).alias("side"), "entry", "v", F.lit(None).cast("array<long>").alias("ids"), "cells", "probes")

    def score(batches):
        current, held, stack = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:]):
                place, side = tuple(keys[a, :4].tolist()), keys[a, 4]
                part = batch.slice(a, b - a)
                if place != current:
                    current, held, stack = place, [], None
                if side == 0:
                    held.append((V.matrix(part.column(6), width), part.column(7), part.column(8)))
                    continue
                if not held:
                    continue
                if stack is None:  # one entry may stand for several ids; entries of a cell are neighbours
                    x = np.concatenate([h[0] for h in held])
                    ids = [i for h in held for i in h[1].to_pylist()]
                    cell = np.concatenate([h[2].flatten().to_numpy() for h in held])
                    order = np.argsort(cell, kind="stable")
                    times = np.array([len(i) for i in ids])[order]
                    cell = np.repeat(cell[order], times)
                    stack = (x[np.repeat(order, times)], np.array([v for e in order for v in ids[e]], dtype=np.int64), cell, *np.divmod(cell, signed))
                x, ids, cell, first, second = stack
                q = V.matrix(part.column(6), width)
                out_ids, out_scores = [], []
                looked = part.column(9)[0].as_py()  # the same for all queries of a place
                for i, wanted in enumerate(part.column(8)):
                    if not wanted.is_valid and looked >= whole:
                        some_x, some_ids = x, ids
                    elif not wanted.is_valid:
                        if i % 64 == 0:
                            both = [turned(directions(q[i : i + 64]), place[1], number) for number in (0, 1)]
                        a, b = both[0][i % 64], both[1][i % 64]
                        at = np.flatnonzero(a[first] + b[second] >= least_sum(a, b, looked))
                        some_x, some_ids = x[at], ids[at]
                    else:
                        wanted = wanted.values.to_numpy()
                        low, size = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, side="right")
                        size = size - low
                        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                        some_x, some_ids = x[at], ids[at]
                    some = V.best(some_x @ q[i], some_ids, 2 * k + 2)
                    exact = (some_x[some] * q[i]).sum(axis=1)
                    keep = V.best(exact, some_ids[some], k + 1)
                    out_ids.append(some_ids[some][keep].tobytes())
                    out_scores.append(exact[keep].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(5), pa.array(out_ids, pa.binary()), pa.array(out_scores, pa.binary())], ["entry", "ids", "scores"])

    def searched(blocks: DataFrame, probes_: DataFrame) -> DataFrame:
        parts = (
            blocks.unionByName(sent(probes_)).repartition(*place).sortWithinPartitions(*place, "side")
            .mapInArrow(score, "entry long, ids binary, scores binary")
        )
        return V.merge_best(parts, "entry", k + 1, "float64")

    probed = asked.select("entry", "v").mapInArrow(probe, "entry long, v array<double>, table int, cells array<long>").join(layout, "table")
    probed = probed.withColumn("cells", F.when(F.col("listed"), F.slice("cells", 1, F.col("probes"))))
    merged = W.stored(searched(held, probed), "found")
    full = merged.where(F.length("ids") >= 8 * (k + 1))
    short = W.stored(asked.select("entry", "v").join(full.select("entry"), "entry", "left_anti"), "short")
    if not W.empty(short):
        one_table = F.col("table") <= 0
        every = short.crossJoin(layout.where(one_table)).withColumns({"cells": F.lit(None).cast("array<long>"), "probes": F.lit(whole)})
        merged = full.unionByName(searched(held.where(one_table), every))

    def results(batches):
        for batch in batches:
            out = ([], [], [], [])
            for q, ids, scores in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rank = 0
                for i, s in zip(np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(scores).tolist()):
                    if i != q and rank < k:
                        rank += 1
                        for values, v in zip(out, (q, rank, i, s)):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    return queries.join(merged, "entry").select("vec_id", "ids", "scores").mapInArrow(results, schema)
