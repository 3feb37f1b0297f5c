"""Counts and strata against brute force, including a case that holds a third of all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewatch.operators import cases as C
from casewatch.operators import exposure as E
from casewatch.operators import signals as SG

CLASSES = {"A": ("RED", "BLUE"), "B": ("OLD",)}
LEVELS = {"PT": "pt", "SOC": "soc"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    drugs = ["RED ROD", "BLUE X", "COLD CUP", "OLD JAR", "PLAIN", ""]
    out = []
    for i in range(900):
        case = 7 if i % 3 == 0 else rng.randrange(120)
        out.append((case, rng.choice(drugs), rng.choice(["PS", "SS", "C", "I"]), rng.choice(["p1", "p2", "p3", ""]),
                    rng.choice(["s1", "s2"])))
    return out


@pytest.fixture(scope="module")
def reports(spark, rows):
    return spark.createDataFrame(rows, "case_id long, drug string, role string, pt string, soc string")


def brute(rows, by_drug, comparator):
    universe = {r[0] for r in rows}
    exposed, any_exposed, terms = {}, set(), {}
    for case, drug, role, pt, soc in rows:
        for term in (("PT", pt), ("SOC", soc)):
            if term[1]:
                terms.setdefault(term, set()).add(case)
        if role in ("PS", "SS"):
            for label, words in CLASSES.items():
                if any(w in drug for w in words):
                    exposed.setdefault(drug if by_drug else label, set()).add(case)
                    any_exposed.add(case)
    out = set()
    for e, cases in exposed.items():
        others = universe - (cases if comparator == "rest" else any_exposed)
        for (level, term), with_term in terms.items():
            a = len(cases & with_term)
            if a:
                b = len(others & with_term)
                out.add((level, e, term, a, b, len(cases) - a, len(others) - b))
    return out


@pytest.mark.parametrize("comparator", ["rest", "unexposed"])
def test_class_counts(reports, rows, comparator):
    got = SG.class_counts(reports, CLASSES, comparator, levels=LEVELS)
    assert {tuple(r) for r in got.collect()} == brute(rows, False, comparator)


@pytest.mark.parametrize("comparator", ["rest", "unexposed"])
def test_drug_counts(reports, rows, comparator):
    got = SG.drug_counts(reports, CLASSES, comparator, levels=LEVELS)
    assert {tuple(r) for r in got.collect()} == brute(rows, True, comparator)


def test_cells_add_up_to_the_universe(reports, rows):
    got = SG.class_counts(reports, CLASSES, include_zero=True, levels=LEVELS)
    n = len({r[0] for r in rows})
    assert {r["a"] + r["b"] + r["c"] + r["d"] for r in got.collect()} == {n}


def test_unknown_comparator(reports):
    with pytest.raises(ValueError):
        SG.class_counts(reports, CLASSES, "nobody", levels=LEVELS)


def test_no_exposure_at_all(reports):
    assert SG.class_counts(reports, {"Z": ("NOTHING",)}, levels=LEVELS).count() == 0


def test_min_cell(reports):
    counts = SG.class_counts(reports, CLASSES, levels=LEVELS)
    values = sorted(r["a"] for r in counts.collect())
    limit = values[len(values) // 2]
    kept = SG.signal_table(counts, "Class", min_cell=limit)
    assert sorted(r["a"] for r in kept.collect()) == [v for v in values if v >= limit] != values


def test_dictionary_join_equals_literals(spark, reports):
    from casewatch.sources import lookup_from_dict

    joined = E.join_dictionary(reports, lookup_from_dict(spark, CLASSES), "contains").filter(E.in_roles(("PS", "SS")))
    left = {tuple(r) for r in joined.select("case_id", "label").distinct().collect()}
    right = {tuple(r) for r in E.class_exposures(reports, CLASSES).collect()}
    assert left == right


def test_dictionary_join_with_short_and_empty_keys(spark):
    from casewatch.sources import lookup_from_dict

    reports = spark.createDataFrame([(1, "ab cd"), (2, "x"), (3, ""), (4, None), (5, "CDAB")], "case_id long, drug string")
    lookup = lookup_from_dict(spark, {"p": ["b", ""], "q": ["cd", "B CD"], "r": ["x", "abcdefgh"]})
    got = {(r["case_id"], r["label"]) for r in E.join_dictionary(reports, lookup, "contains").collect()}
    assert got == {(1, "p"), (1, "q"), (2, "r"), (5, "p"), (5, "q")}


def test_large_dictionary_meets_few_names(spark):
    """10,000 keys that all begin alike: the pairs looked at stay near the pairs that match."""
    rng = random.Random(8)

    def word(n):
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    keys = ["ACETYL" + word(5) for _ in range(9990)] + ["A", "AC", "\u00c4B", "ACETYL", "%", "_A"] + ["TYL" + word(2) for _ in range(4)]
    drugs = ["ACETYL" + word(7) for _ in range(2000)] + [rng.choice(keys) + " " + word(3) for _ in range(300)] + ["\u00e4bc", "", None, "x%y"]
    names = {d.upper() for d in drugs if d}
    reports = spark.createDataFrame(list(enumerate(drugs)), "case_id long, drug string")
    lookup = spark.createDataFrame([(k, f"L{i % 7}") for i, k in enumerate(keys)], "key string, label string")
    matching = {(d, k) for d in names for k in keys if k in d}
    pairs = [tuple(r) for r in E.name_candidates(E.distinct_names(reports), E.upper_keys(lookup)).collect()]
    assert len(pairs) == len(set(pairs)) and matching <= set(pairs)
    assert len(pairs) < len(matching) + 2 * len(keys)
    assert sum(d.startswith("ACE") for d in names) * len(keys) > 100 * len(pairs)  # what meeting by first letters would cost
    label = {k: f"L{i % 7}" for i, k in enumerate(keys)}
    want = {(i, label[k]) for i, d in enumerate(drugs) if d for k in keys if k in d.upper()}
    joined = E.join_dictionary(reports, lookup, "contains").collect()
    assert len(joined) == len(want) and {(r["case_id"], r["label"]) for r in joined} == want


def test_strata_and_roll_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice("uv"), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(500)]
    cases = spark.createDataFrame(rows, "g string, h string, exposed_a int, exposed_b int, outcome int")
    labels = {"exposed_a": "A", "exposed_b": "B"}
    fine = SG.stratified_counts(cases, labels, ["g", "h"])
    want = Counter()
    for g, h, a, b, y in rows:
        for label, e in (("A", a), ("B", b)):
            want[(label, g, h, "abcd"[(1 - e) * 2 + (1 - y)])] += 1
    for r in fine.collect():
        assert [r[x] for x in "abcd"] == [want[(r["exposure"], r["g"], r["h"], x)] for x in "abcd"]
    rolled = {tuple(r) for r in SG.roll_up(fine, ["g"]).collect()}
    assert rolled == {tuple(r) for r in SG.stratified_counts(cases, labels, ["g"]).collect()}


def test_conflicting_attributes_of_a_case(spark):
    rows = [(1, "RED", "PS", 1, "F", "US", "30", "YR", "GRAFT", 1), (1, "X", "C", 9, "M", "JAPAN", None, None, None, None),
            (2, "Y", "PS", 9, None, None, "", "", None, 0)]
    reports = spark.createDataFrame(
        rows, "case_id long, drug string, role string, pt_code long, sex string, region string, age string, "
              "age_unit string, indication string, s int")
    single = {r["case_id"]: r for r in C.subgroup_universe(reports, CLASSES, [1], "contains", serious_flags=["s"]).collect()}
    assert (single[1]["sex_grp"], single[1]["region_grp"], single[1]["age_group"]) == ("F", "US", "18-39")
    assert (single[1]["indication_grp"], single[1]["serious_grp"], single[1]["outcome"]) == ("Transplantation", "Serious", 1)
    assert (single[2]["sex_grp"], single[2]["region_grp"], single[2]["age_group"]) == ("Other", "OTHER", None)
    assert (single[1]["exposed_a"], single[2]["exposed_a"]) == (1, 0)
    many = C.subgroup_universe(reports, CLASSES, [1], "contains", serious_flags=["s"], multi=True)
    assert {(r["case_id"], r["sex_grp"], r["region_grp"]) for r in many.collect()} == {
        (1, "F", "US"), (1, "M", "JAPAN"), (2, "Other", "OTHER")}


def test_grid_equals_one_stratification_at_a_time(spark):
    import random

    from pyspark.sql import functions as F

    from casewatch.operators import signals as SG

    rng = random.Random(2)
    rows = [(i, rng.choice("FM"), rng.choice(["a", "b", None]), rng.choice("xyz"), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1)) for i in range(300)]
    cases = spark.createDataFrame(rows, "case_id long, s string, g string, r string, e1 int, e2 int, outcome int")
    labels, sets = {"e1": "One", "e2": "Two"}, [("s",), ("g",), ("s", "r")]
    grid = SG.stratified_grid(cases, labels, sets)
    for names in sets:
        want = SG.stratified_counts(cases.dropna(subset=list(names)), labels, list(names))
        own = grid.where(F.col("stratification") == " x ".join(names)).select(want.columns)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
    scans = grid._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans == 1 and SG.stratified_grid(cases.where("false"), labels, sets).collect() == []


def test_pieces_of_reports_follow_their_size(spark, sf_dir):
    from casewatch.plans.carrier import report_table

    report_table(spark, sf_dir)  # applies the settings; the session has 4 shuffle partitions
    rows = spark.range(3_000_000).select("id", F.md5(F.col("id").cast("string")).alias("term"))

    def pieces(df):
        return df.groupBy("term").count().select(F.spark_partition_id().alias("p")).distinct().count()

    assert pieces(rows) > 8
    assert pieces(rows.limit(100)) == 1


def test_number_of_pieces_follows_the_stored_bytes(spark, tmp_path, monkeypatch):
    from casewatch import session

    path = str(tmp_path / "reports")
    spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("term")).repartition(4).write.parquet(path)
    reports = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "reports").glob("part-*"))
    assert session.stored_bytes(reports) == size
    assert session.pieces_for(size) == 400  # as before for small inputs
    assert session.pieces_for(4_000_000_000) == 954 and session.pieces_for(40_000_000_000) == 9537
    monkeypatch.setattr(session, "STORED_BYTES_A_PIECE", 1000)
    session.tune(spark, reports=reports)
    number = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    assert number == -(-size // 1000) > 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "400")
