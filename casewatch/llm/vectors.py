"""Dense vectors in Arrow batches, and running best lists per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(vec_id long, v array<double>) without null vectors and such with null or non-finite components.

    `zero` keeps vectors of zeros. Rows without an id take no part either.
    """
    v = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    out = out.where(F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    return out if zero else out.where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: largest score first, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def merge_best(parts: DataFrame, query: str, k: int, dtype: str) -> DataFrame:
    """(query, ids binary, scores binary): the k best of all partial lists of a query, merged one after another."""
    kind = np.dtype(dtype)

    def run(batches):
        current, ids, scores = None, None, None
        done: list[list] = [[], [], []]

        def top(some_ids, some_scores):
            order = np.lexsort((-some_scores, some_ids))  # of a repeated id the best score stays
            order = order[np.diff(some_ids[order], prepend=some_ids[order[:1]] - 1) != 0]
            some_ids, some_scores = some_ids[order], some_scores[order]
            keep = best(some_scores, some_ids, k)
            return some_ids[keep], some_scores[keep]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.binary()), pa.array(done[2], pa.binary())], [query, "ids", "scores"])
            for d in done:
                d.clear()
            return out

        def close():
            if current is not None:
                for d, v in zip(done, (current, ids.tobytes(), scores.tobytes())):
                    d.append(v)

        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in range(3))):
                new_ids, new_scores = np.frombuffer(i, dtype=np.int64), np.frombuffer(s, dtype=kind)
                if q != current:
                    close()
                    current, (ids, scores) = q, top(new_ids, new_scores)
                    continue
                ids, scores = top(np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores]))
            if len(done[0]) > 1000:
                yield flush()
        close()
        yield flush()

    return parts.select(query, "ids", "scores").repartition(query).sortWithinPartitions(query).mapInArrow(run, f"{query} long, ids binary, scores binary")
