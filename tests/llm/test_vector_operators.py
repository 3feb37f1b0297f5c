"""Vector searches against brute force, and the pipeline's stages on a small table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewatch.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


@pytest.fixture(scope="module")
def rows(sf_dir, spark):
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    copies = [(10_000 + 10 * i, table[3][1]) for i in range(12)]
    odd = [(20_000, None), (20_020, [0.0] * 64), (20_040, [float("nan")] * 64), (20_060, [None] * 64), (None, table[0][1])]
    return table + copies + odd


def usable(rows, zero):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    return {i: v for i, v in good.items() if zero or v.any()}


def test_exact_top_k(spark, rows):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    good = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(frame, lambda c: c % 50 == 0, block=32, group=2).collect()} == want
    assert topk.top_k(frame.limit(0), lambda c: c % 50 == 0).count() == 0


def test_pruning_skips_blocks():
    rng = np.random.default_rng(1)
    blocks = [(np.arange(50) + 50 * b, rng.integers(0, 5, (50, 8)) + (100 if b == 0 else 0)) for b in range(10)]
    q = np.ones((1, 8), dtype=np.int64)
    lists, scored = topk.search(q, np.array([-1]), np.array([np.iinfo(np.int64).min]), blocks, 5)
    assert scored.tolist() == [50] and lists[0][1].max() < 50


def test_clustered_vectors_reach_few_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 32))
    x[::100] *= 0.5  # norms differ
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(np.int64)
    want = set()
    for q in range(0, 4000, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:5]
        want |= {(q, k, int(i), int(scores[i])) for k, i in enumerate(order, 1)}
    ask = dict(is_query=lambda c: c % 50 == 0, block=32, group=2)
    assert {tuple(r) for r in topk.top_k(frame, **ask).collect()} == want
    scored = topk.work(frame, **ask).collect()
    assert len(scored) == 80 and sum(r["n_scored"] for r in scored) < 0.3 * 80 * 4000


def test_vectors_of_odd_widths(spark):
    rows = [(0, []), (50, [1.0]), (50, [1.0]), (1, [2.0, -1.0, 0.5]), (2, [0.0]), (100, None), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = {tuple(r) for r in topk.top_k(frame, lambda c: c % 50 == 0).collect()}
    first = {(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 50, 0)}
    assert got == first | {(50, 1, 1, 256 * 512), (50, 2, 0, 0), (50, 3, 2, 0)}
    assert topk.top_k(frame.where("vec_id = 0"), lambda c: c % 50 == 0).count() == 0
    assert topk.top_k(frame.where("vec_id = 0 or vec_id is null"), lambda c: c % 50 == 0).count() == 0


def test_nearest_neighbours(spark, rows):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    good = usable(rows, False)
    got = {}
    for r in ann.nearest(frame, lambda c: c % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-float(v @ good[q]), i) for i, v in good.items() if i != q)[:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert all(s == pytest.approx(float(good[q] @ good[i]), abs=1e-12) for _, i, s in found)
        assert q not in [i for _, i, _ in found]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        total += len(best)
    assert hits >= 0.9 * total
    assert ann.nearest(frame.limit(0), lambda c: c % 20 == 0).count() == 0


def test_norms_that_differ(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.2, 3, size=(300, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, lambda c: c % 20 == 0, k=5).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 300, 20):
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:5]
        hits += len(found[q] & set(map(int, order)))
    assert hits >= 0.9 * 75


def test_one_very_long_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x[7] *= 100
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, lambda c: c % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 2000, 20):
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:20]
        assert len(found[q]) == 20
        hits += len(set(found[q]) & set(map(int, order)))
    assert hits >= 0.9 * 2000


@pytest.mark.parametrize("n", [20_000])
def test_cells_save_products(n):
    """Recall of the 20 best and products a query, at production parameters, on directions without any clusters."""
    rng = np.random.default_rng(6)
    x = ann.directions(rng.normal(size=(n, 64)))
    probes = int(128 * 128 * ann.SHARE * (200_000 / n) ** 0.25)
    found, products = np.zeros((50, n), dtype=bool), 0
    for t in range(ann.TABLES):
        own = np.concatenate([a * 128 + b for a, b in (ann.cells(x[i : i + 5000], t, 1) for i in range(0, n, 5000))])[:, 0]
        a, b = ann.cells(x[:50], t, probes)
        for i, wanted in enumerate(a * 128 + b):
            some = np.isin(own, wanted)
            products += some.sum()
            found[i] |= some
    scores = x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = -2
    best = np.argsort(-scores, axis=1)[:, :20]
    recall, share = np.take_along_axis(found, best, axis=1).mean(), products / 50 / n
    print(n, recall, share)
    assert recall >= 0.9 and share <= 0.3


def test_no_step_by_the_number_of_vectors(spark):
    probes = [ann.probed_cells(n, 128) for n in range(1, 40_000)]
    assert probes[0] == 128 * 128 and all(0 <= a - b <= 0.02 * a + 1 for a, b in zip(probes, probes[1:]))
    # 400 vectors are searched by their cells, as more are; all are looked at only where too few are found
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[1] = -x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"] for r in ann.nearest(frame, lambda c: c == 0, k=398).collect()}
    whole = {r["vec_id"] for r in ann.nearest(frame, lambda c: c == 0, k=399).collect()}
    assert len(whole) == 399 and found <= whole
    assert {r["vec_id"] for r in ann.nearest(frame, lambda c: c == 0, k=20).collect()} <= set(np.argsort(-(x @ x[0]))[1:40].tolist())


@pytest.mark.parametrize("clusters", [False, True])
def test_wide_vectors_reach_the_recall(spark, clusters):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 200))
    if clusters:
        x = 0.5 * x + rng.normal(size=(100, 200))[rng.integers(0, 100, 4000)]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, lambda c: c % 40 == 0, block=1000).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 40):
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:20]
        assert len(found[q]) == 20
        hits += len(set(found[q]) & set(map(int, order)))
    assert hits >= 0.9 * 2000


def test_number_of_cells_is_not_capped():
    for n in (8_000, 9_000, 200_000):
        assert ann.probed_cells(n, 512) >= 512 * 512 * ann.SHARE
    x = ann.directions(np.random.default_rng(13).normal(size=(5, 32)))
    a, b = ann.turned(x, 0, 0), ann.turned(x, 0, 1)
    for probes in (1, 30, 700, 64 * 64):
        first, second = ann.cells(x, 0, probes)
        for i in range(5):
            sums = np.sort((a[i][:, None] + b[i]).ravel())[::-1]
            assert a[i][first[i]] + b[i][second[i]] == pytest.approx(sums[:probes])
            assert len(set(zip(first[i], second[i]))) == probes
            assert probes <= (sums >= ann.least_sum(a[i], b[i], probes)).sum() <= probes + 2


def test_whole_search_where_cells_hold_too_few(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(700)] + [(900, [-1.0, -1.0, -1e-3]), (900, [-1.0, -1.0, -1e-3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x, ids = np.array([v for _, v in rows[:-1]]), np.array([i for i, _ in rows[:-1]])
    got = ann.nearest(frame, lambda c: c % 300 == 0, k=5, small_zone=0, tables=2).collect()
    for q in (0, 300, 600, 900):
        found = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in found] == [1, 2, 3, 4, 5] and q not in [i for _, i in found]
    assert all(r["score"] == pytest.approx(float(x[ids == r["query_id"]][0] @ x[ids == r["vec_id"]][0])) for r in got)


def test_pipeline_stages(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"one {passage}", "en", "s", 10), (2, f"one {passage}", "en", "s", 10), (3, " ".join(f"q{i}" for i in range(90)) + " " + passage, "en", "s", 9), (4, None, None, None, None), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
        current.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r["doc_id"]: r["text"] for r in current.collect()}
    assert kept == {1: f"one {passage}", 3: " ".join(f"q{i}" for i in range(90)), 4: None, None: "no id"}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg(F.countDistinct("sequence_id")).first()[0] == 1 and packed.count() == 4


def test_a_repeated_id_keeps_its_best_score(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.randint(0, 30), [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(90)] + [(None, [1.0] * 4), (50, None), (50, [0.5, None, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    floors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v]
    for block in (1, 7, 64):
        want = {}
        for q, v in floors:
            if q % 10 == 0:
                best = want.setdefault(q, {})
                for i, w in floors:
                    if i != q:
                        best[i] = max(best.get(i, -1 << 60), sum(a * b for a, b in zip(v, w)))
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, lambda c: c % 10 == 0, k=5, block=block, group=1).collect()}
        assert got == {
            (q, rank, i, s) for q, best in want.items() for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)
        }
