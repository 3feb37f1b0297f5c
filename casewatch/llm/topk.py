"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integer term weights. They are ordered by their nearest two of PIVOTS sampled vectors, so that alike ones are
neighbours, and cut into ranges: a tile is a range of the order, a block BLOCK vectors of a tile with a forward index
(its vectors) and the least and largest weight of each term. The bound of a block or tile for a query is the sum over terms of
the best product those limits allow; what lies below the query's k-th best score so far cannot matter (an equal bound
is still scored, for ties).

A query's k-th best starts from the GROUP blocks around itself. Then it goes to the FIRST tiles of highest bound, and with the
k-th best of these to the others whose bound still reaches it, and to no more. Inside a tile blocks are scored whole in order of
falling bound, the first TURNS in each query's own order, the others in one order for the queries that they still matter to. Only lists of k go on. Work is queries x vectors at most, for vectors without any clusters; the copies of a
query are as many as the tiles it reaches.

Sizes: a task holds one tile and streams queries past it. There are at least shuffle-partitions tiles, more so that a tile
has some TILE vectors, but at most MOST_TILES; their limits (two vectors a tile) and the pivots are all that reaches
the driver and all tasks.

Vectors null or holding null or non-finite components take no part; zero vectors do. Shorter vectors count as
filled with zeros. Rows that repeat an id are one candidate, with its best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import vectors as V
from casewatch.llm import words as W

SCALE = 256
BLOCK = 64
GROUP = 16
TURNS = 8
PIVOTS = 256
FIRST = 2
TILE = 1 << 17
MOST_TILES = 1 << 14


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; through doubles where those are exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if largest < 1 << 53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(ids, return_index=True)
    if len(unique) < len(ids):
        scores = np.array([scores[ids == i].max() for i in unique])
        ids = unique
    keep = V.best(scores, ids, k)
    return scores[keep], ids[keep]


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest possible product of each query with a vector between each pair of limits."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


def search(q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
    """Best (scores, ids) lists of each query over the blocks, and the number of vectors scored for each query."""
    low = np.stack([x.min(axis=0) for _, x in blocks])
    high = np.stack([x.max(axis=0) for _, x in blocks])
    bound = bounds(q, low, high)
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.copy()
    none = np.zeros(0, dtype=np.int64)
    lists, scored = [(none, none)] * len(q), np.zeros(len(q), dtype=np.int64)
    todo = np.ones(bound.shape, dtype=bool)

    def score(b: int, rows: np.ndarray) -> None:
        ids, x = blocks[b]
        scores = products(q[rows], x)
        scored[rows] += len(ids)
        todo[rows, b] = False
        for at in np.flatnonzero((scores >= kth[rows, None]).any(axis=1)):
            row, s = rows[at], scores[at]
            use = (s >= kth[row]) & (ids != query_ids[row])
            if use.any():
                lists[row] = _top(np.concatenate([lists[row][0], s[use]]), np.concatenate([lists[row][1], ids[use]]), k)
                if len(lists[row][0]) == k:
                    kth[row] = max(kth[row], lists[row][0][-1])

    for turn in range(min(TURNS, len(blocks))):  # each query's own order
        at = order[:, turn]
        live = np.flatnonzero(bound[np.arange(len(q)), at] >= kth)
        for b in np.unique(at[live]):
            score(b, live[at[live] == b])
    left = np.where(todo, bound, np.iinfo(np.int64).min).max(axis=0, initial=np.iinfo(np.int64).min)
    for b in np.argsort(-left.astype(np.float64), kind="stable"):  # the rest for all queries that a block still matters to
        rows = np.flatnonzero(todo[:, b] & (bound[:, b] >= kth))
        if len(rows):
            score(b, rows)
    return lists, scored


def _array(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.int64)
    return x.reshape(-1, width) if width else x.reshape(1, 0)


def _pivots(rows: DataFrame, width: int) -> np.ndarray:
    """At most PIVOTS different vectors: of each class of vector hashes the one with the least hash."""

    def least(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            h = batch.column(1).to_numpy()
            x = V.matrix(batch.column(0), width).astype(np.int64)
            order = np.lexsort((h, h % PIVOTS))
            slot = h[order] % PIVOTS
            for i in order[np.diff(slot, prepend=-1) != 0]:
                s = int(h[i] % PIVOTS)
                if s not in held or h[i] < held[s][0]:
                    held[s] = (int(h[i]), x[i].tobytes())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.binary())], ["slot", "h", "v"])

    some = rows.select("v", F.xxhash64("v").alias("h")).mapInArrow(least, "slot int, h long, v binary")
    best = some.groupBy("slot").agg(F.min(F.struct("h", "v")).alias("m")).orderBy("slot").collect()
    return np.concatenate([_array(r["m"]["v"], width) for r in best])


def _blocks(rows: DataFrame, width: int, pivots: np.ndarray, tiles: int, block: int, group: int) -> DataFrame:
    """(tile, ids, vectors, asked): up to `group` blocks a row, neighbours in the order of the nearest pivots."""
    length = (pivots * pivots).sum(axis=1)

    def near(batches):
        for batch in batches:
            x = V.matrix(batch.column(1), width)
            away = length - 2 * (x @ pivots.T.astype(np.float64))
            first = away.argmin(axis=1)
            away[np.arange(len(x)), first] = np.inf
            cell = first * len(pivots) + away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(cell.astype(np.int32))], ["vec_id", "v", "asked", "cell"])

    def cut(batches):
        from pyspark import TaskContext

        tile, most = TaskContext.get().partitionId(), block * group
        ids, vs, asked = np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=bool)

        def pack(n):
            arrays = [pa.array([tile], pa.int32()), *(pa.array([x[:n].tobytes()], pa.binary()) for x in (ids, vs, asked))]
            return pa.RecordBatch.from_arrays(arrays, ["tile", "ids", "vectors", "asked"])

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            vs = np.concatenate([vs, V.matrix(batch.column(1), width).astype(np.int64)])
            asked = np.concatenate([asked, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)])
            while len(ids) >= most:
                yield pack(most)
                ids, vs, asked = ids[most:], vs[most:], asked[most:]
        if len(ids):
            yield pack(len(ids))

    placed = rows.mapInArrow(near, "vec_id long, v array<long>, asked boolean, cell int")
    ordered = placed.repartitionByRange(tiles, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").select("vec_id", "v", "asked")
    return W.stored(ordered.mapInArrow(cut, "tile int, ids binary, vectors binary, asked binary"), "blocks")


def _limits(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile numbers with the least and largest weights of their vectors."""

    def least(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for tile, raw, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(raw, dtype=np.int64).reshape(len(ids) // 8, width)
                low, high = x.min(axis=0), x.max(axis=0)
                if tile in held:
                    low, high = np.minimum(low, held[tile][0]), np.maximum(high, held[tile][1])
                held[tile] = (low, high)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1))], ["tile", "low", "high"])

    parts: dict[int, tuple] = {}
    for tile, low, high in blocks.select("tile", "vectors", "ids").mapInArrow(least, "tile int, low binary, high binary").collect():
        low, high = _array(low, width)[0], _array(high, width)[0]
        old = parts.get(tile, (low, high))
        parts[tile] = (np.minimum(low, old[0]), np.maximum(high, old[1]))
    return np.array(list(parts), dtype=np.int32), np.stack([v[0] for v in parts.values()]), np.stack([v[1] for v in parts.values()])


def _lists(df: DataFrame, is_query, k: int, scale: int, block: int, group: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame] | None:
    """Partial lists (query_id, ids, scores) of all queries, and (query_id, n_scored) of the vectors scored for them."""
    spark = df.sparkSession
    W.small_batches(spark, 256)
    rows = V.usable(df, id_col, vector_col, zero=True)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("asked"))
    rows = W.stored(rows, "terms")
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if width is None:
        return None
    tiles = min(MOST_TILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TILE)))
    blocks = _blocks(rows, width, _pivots(rows, width), tiles, block, group)
    numbers, low, high = _limits(blocks, width)
    lowest = np.iinfo(np.int64).min

    def cut(ids: bytes, raw: bytes) -> list:
        i = np.frombuffer(ids, dtype=np.int64)
        x = np.frombuffer(raw, dtype=np.int64).reshape(len(i), width)
        return [(i[a : a + block], x[a : a + block]) for a in range(0, len(i), block)]

    def kth(scores: np.ndarray) -> int:
        return int(scores[-1]) if len(scores) == k else lowest

    def seed(batches):
        for batch in batches:
            for ids, raw, asked in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                at = np.flatnonzero(np.frombuffer(asked, dtype=bool))
                if not len(at):
                    continue
                held = cut(ids, raw)
                own, q = np.frombuffer(ids, dtype=np.int64)[at], np.concatenate([x for _, x in held])[at]
                lists, scored = search(q, own, np.full(len(at), lowest), held, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([kth(s) for s, _ in lists], pa.int64()), pa.array(scored)],
                    ["query_id", "vector", "floor", "n_scored"],
                )

    queries = W.stored(blocks.mapInArrow(seed, "query_id long, vector binary, floor long, n_scored long"), "queries")

    def sent(first: bool):
        """Copies of the queries for the tiles that they reach: the FIRST ones of highest bound, or the others."""

        def run(batches):
            for batch in batches:
                ids, floor = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                if not len(ids):
                    continue
                q = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64).reshape(len(ids), width)
                if not first:
                    floor = np.maximum(floor, [lowest if s is None else kth(np.frombuffer(s, dtype=np.int64)) for s in batch.column(3).to_pylist()])
                bound = bounds(q, low, high)
                turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                row, at = np.nonzero((bound >= floor[:, None]) & ((turn < FIRST) == first))
                for a in range(0, len(row), 4096):
                    r = row[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at[a : a + 4096]]), pa.array(ids[r]), batch.column(1).take(pa.array(r)), pa.array(floor[r])], ["tile", "id", "vector", "floor"])

        return run

    def score(batches):
        current, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:]):
                part, (tile, side) = batch.slice(a, b - a), keys[a]
                if tile != current:
                    current, held = tile, []
                if side == 0:
                    for ids, x in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                        held.extend(cut(ids, x))
                    continue
                ids = part.column(2).to_numpy()
                q = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.int64).reshape(len(ids), width)
                lists, scored = search(q, ids, part.column(5).to_numpy(), held, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([i.tobytes() for _, i in lists], pa.binary()), pa.array([s.tobytes() for s, _ in lists], pa.binary()), pa.array(scored)],
                    ["query_id", "ids", "scores", "n_scored"],
                )

    one, no = F.lit(0).cast("long"), F.lit(None).cast("binary")
    held = blocks.select("tile", F.lit(0).alias("side"), one.alias("id"), "ids", F.col("vectors").alias("vector"), one.alias("floor"))

    def scored(copies: DataFrame, name: str) -> DataFrame:
        copies = copies.select("tile", F.lit(1).alias("side"), "id", no.alias("ids"), "vector", "floor")
        both = held.unionByName(copies).repartition(tiles, "tile").sortWithinPartitions("tile", "side")
        return W.stored(both.mapInArrow(score, "query_id long, ids binary, scores binary, n_scored long"), name)

    copy = "tile int, id long, vector binary, floor long"
    best = scored(queries.select("query_id", "vector", "floor").mapInArrow(sent(True), copy), "first")
    merged = V.merge_best(best, "query_id", k, "int64").select("query_id", "scores")
    rest = queries.select("query_id", "vector", "floor").join(merged, "query_id", "left")
    others = scored(rest.mapInArrow(sent(False), copy), "others")
    work = [d.select("query_id", "n_scored") for d in (queries, best, others)]
    return best.unionByName(others), work[0].unionByName(work[1]).unionByName(work[2])


def top_k(df: DataFrame, is_query, k: int = 5, scale: int = SCALE, block: int = BLOCK, group: int = GROUP,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every row for which is_query(id column) holds."""
    schema = "query_id long, rank int, vec_id long, score long"
    found = _lists(df, is_query, k, scale, block, group, id_col, vector_col)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)

    def results(batches):
        for batch in batches:
            out = ([], [], [], [])
            for q, ids, scores in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for rank, (i, s) in enumerate(zip(np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(scores, dtype=np.int64).tolist()), 1):
                    for values, v in zip(out, (q, rank, i, s)):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])

    return V.merge_best(found[0], "query_id", k, "int64").mapInArrow(results, schema)


def work(df: DataFrame, is_query, k: int = 5, scale: int = SCALE, block: int = BLOCK, group: int = GROUP,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, n_scored): how many vectors each query was scored against, seeding included."""
    found = _lists(df, is_query, k, scale, block, group, id_col, vector_col)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, n_scored long")
    return found[1].groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"))
