import json

import pytest
from pyspark.sql import functions as F

from casewatch import sources as S
from casewatch.operators.cases import outcome_by_code_or_name
from casewatch.sources.binding import resolve


def test_first_candidate_wins_and_optional_is_null(spark):
    df = spark.createDataFrame([(1, "X", "PS", 5)], "PrimaryId long, DRUGNAME string, role_cod string, pt_code int")
    row = S.bind_columns(df, S.FIRST_SOURCE).first()
    assert (row["case_id"], row["drug"], row["pt_code"], row["sex"]) == (1, "X", 5, None)


def test_case_sensitive_binding():
    logical = S.Logical("drug", ("drugname", "DRUGNAME"))
    assert resolve(["DRUGNAME"], logical, case_sensitive=True) == "DRUGNAME"
    with pytest.raises(ValueError, match="drug"):
        resolve(["DrugName"], logical, case_sensitive=True)


def test_unique_like():
    logical = S.Logical("serious", ("serious_flag",), optional=True, unique_like="serious")
    assert resolve(["a", "is_SERIOUS"], logical) == "is_SERIOUS"
    assert resolve(["a"], logical) is None
    assert resolve(["serious_x", "serious_flag"], logical) == "serious_flag"
    with pytest.raises(ValueError, match="several"):
        resolve(["serious_a", "serious_b"], logical)


def test_required_column_missing(spark):
    with pytest.raises(ValueError, match="case_id"):
        S.bind_columns(spark.createDataFrame([(1,)], "x int"), S.SECOND_SOURCE)


def test_lookup_headers_and_empty_names(spark, tmp_path):
    (tmp_path / "l.csv").write_text("MedDRA code,Preferred\n10, renal failure \n10, renal failure \n11,\n")
    rows = {tuple(r) for r in S.read_lookup(spark, str(tmp_path / "l.csv")).collect()}
    assert rows == {(10, "RENAL FAILURE"), (11, None)}


def test_lookup_without_usable_header(spark, tmp_path):
    (tmp_path / "l.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        S.read_lookup(spark, str(tmp_path / "l.csv"))


def test_empty_lookup_name_never_matches(spark):
    rows = spark.createDataFrame([(1, ""), (2, "B"), (3, None), (9, "z")], "pt_code long, pt string")
    lookup = spark.createDataFrame([(1, ""), (1, ""), (None, "b")], "code long, name string")
    got = {r["pt_code"]: r["outcome"] for r in outcome_by_code_or_name(rows, lookup).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 9: 0}


def test_spec_files(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"coefficients": {"x": 1.5, "y.z": -2}}, indent=2))
    spec = S.read_spec(spark, str(path))
    assert spec.intercept == 0.0 and dict(spec.coefficients) == {"x": 1.5, "y.z": -2.0}
    out = str(tmp_path / "out")
    S.write_spec(S.ModelSpec(-1.0, {"a": 0.5}, "m").frame(spark), out)
    assert S.read_spec(spark, out).intercept == -1.0


def test_spec_without_coefficients(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"intercept": 1.0}))
    with pytest.raises(ValueError, match="coefficients"):
        S.read_spec(spark, str(path))


def test_manifest(spark, tmp_path):
    S.write_manifest(spark, {"n": 3, "names": ["a"]}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["n"] == 3


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "k string, f int")
    assert {tuple(r) for r in S.profile(df, ["f"], "k").collect()} == {("a", 2, 1), ("b", 1, 1)}
    assert tuple(S.profile(df, ["f"]).first()) == (3, 2)


def test_first_source_keeps_seriousness_and_years(spark):
    from casewatch.operators import cases as C
    from casewatch.sources.binding import FIRST_SOURCE, bind_columns

    raw = spark.createDataFrame(
        [(1, "d", "PS", 1, 5.0, "60", "MON", 1), (2, "d", "PS", 1, None, "60", "MON", 0)],
        "primaryid long, drugname string, role_cod string, pt_code long, age_years double, age string, age_cod string, serious_death int",
    )
    bound = bind_columns(raw, FIRST_SOURCE)
    cases = {r["case_id"]: r for r in C.subgroup_universe(bound).collect()}
    assert cases[1]["serious_grp"] == "Serious" and cases[2]["serious_grp"] == "Non-serious"
    ages = {r["case_id"]: r["y"] for r in bound.select("case_id", C.report_age(bound).alias("y")).collect()}
    assert ages == {1: 5.0, 2: 5.0}
    without = C.subgroup_universe(bind_columns(raw.drop("serious_death"), FIRST_SOURCE)).collect()
    assert {r["serious_grp"] for r in without} == {None}


def test_onset_source_reaches_the_onset_table(spark):
    from casewatch.plans.characteristics import onset_cases
    from casewatch.sources.binding import ONSET_SOURCE, bind_columns

    raw = spark.createDataFrame(
        [(1, "TACROLIMUS", "PS", "x", 1, None, 5.0)],
        "primaryid long, drugname_u string, role_cod_u string, pt_u string, meddra_pt_code long, tto_onset_days_psss double, tto_onset_days_ps double",
    )
    row = onset_cases(bind_columns(raw, ONSET_SOURCE), roles=None).first()
    assert row["tto_days"] == 5.0


def test_chain_is_evaluated_by_row_and_traced(spark):
    raw = spark.createDataFrame(
        [(1, "D", "PS", 1, None, "lupus"), (2, "D", "PS", 1, "LUPUS", "x"), (3, "D", "PS", 1, None, None)],
        "primaryid long, drugname string, role_cod string, pt_code long, indi_pt_norm string, indi_pt string",
    )
    bound = S.bind_columns(raw, S.FIRST_SOURCE, traced=("indication", "sex", "drug"))
    got = {r["case_id"]: (r["indication"], r["indication_from"], r["sex_from"], r["drug_from"]) for r in bound.collect()}
    assert got == {
        1: ("lupus", "indi_pt", None, "drugname"), 2: ("LUPUS", "indi_pt_norm", None, "drugname"), 3: (None, None, None, "drugname")
    }
    one = S.bind_columns(raw.drop("indi_pt_norm"), S.FIRST_SOURCE, traced=("indication",))
    assert {r["indication_from"] for r in one.collect()} == {"indi_pt", None}
    with pytest.raises(ValueError, match="nothing"):
        S.bind_columns(raw, S.FIRST_SOURCE, traced=("nothing",))


def test_age_bands_are_bound_only_without_numbers(spark):
    from casewatch.operators.cases import subgroup_universe
    from casewatch.plans.case_features import case_features

    rows = [(1, "TACROLIMUS", "PS", 1, "65+"), (1, "TACROLIMUS", "PS", 1, " 18-39 "), (2, "TACROLIMUS", "PS", 1, "elderly"), (3, "TACROLIMUS", "PS", 1, None)]
    raw = spark.createDataFrame(rows, "primaryid long, drugname string, role_cod string, pt_code long, age_group string")
    bound = S.bind_columns(raw, S.FIRST_SOURCE)
    assert "age_group" in bound.columns
    assert {r["case_id"]: r["age_cat"] for r in case_features(bound).collect()} == {1: "18-39", 2: None, 3: None}
    assert {r["case_id"]: r["age_group"] for r in subgroup_universe(bound).collect()} == {1: "18-39", 2: None, 3: None}
    numbers = S.bind_columns(raw.withColumn("age", F.lit("70")), S.FIRST_SOURCE)
    assert "age_group" not in numbers.columns
    assert {r["age_cat"] for r in case_features(numbers).collect()} == {"65+"}


def folder_names(path):
    return sorted(p.name for p in path.iterdir())


def test_failed_write_leaves_the_old_result(spark, tmp_path):
    target = str(tmp_path / "result")
    rows = [(i, f"v{i}") for i in range(20)]
    S.write_table(spark.createDataFrame(rows, "k int, v string").orderBy(F.desc("k")), target)
    read = lambda: [tuple(r) for r in spark.read.csv(target, header=True, schema="k int, v string").collect()]
    before = (tmp_path / "result").stat().st_ino
    assert sorted(read()) == rows
    failing = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("int").alias("k"))
    with pytest.raises(Exception, match="no"):
        S.write_table(failing, target)
    assert sorted(read()) == rows and folder_names(tmp_path) == ["result"] and (tmp_path / "result").stat().st_ino == before
    S.write_table(spark.createDataFrame([(5, "new")], "k int, v string"), target)
    assert read() == [(5, "new")] and folder_names(tmp_path) == ["result"]


def test_rows_keep_their_order_over_part_files(spark, tmp_path):
    target = str(tmp_path / "ordered")
    S.replace(spark.range(1000).repartitionByRange(5, F.desc("id")).sortWithinPartitions(F.desc("id")), target, "csv")
    parts = sorted(p for p in (tmp_path / "ordered").iterdir() if p.suffix == ".csv")
    assert [int(x) for p in parts for x in p.read_text().split()] == list(range(999, -1, -1)) and len(parts) > 1


def test_reports_by_case_are_grouped_without_a_shuffle(spark, tmp_path):
    from casewatch.operators.cases import subgroup_universe

    columns = "case_id long, drug string, role string, pt_code long, sex string, region string, age string, indication string"
    rows = [(i % 50, "TACROLIMUS", "PS", i % 7, "FM"[i % 2], "US", str(i % 90), "lupus") for i in range(600)]
    raw = spark.createDataFrame(rows, columns)
    stored = S.write_by_case(raw, "reports_by_case_test", str(tmp_path / "by-case"), 4)
    cases = subgroup_universe(stored)
    assert "Exchange" not in cases._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in subgroup_universe(raw)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, cases.collect())) == sorted(map(repr, subgroup_universe(raw).collect()))
    spark.sql("DROP TABLE reports_by_case_test")


RECORD = {
    "family": "binomial", "link": "logit", "alpha": 1, "seed": 1, "folds": 10, "terms": ["a", "b"], "dictionary": {"m": ["X", "Y"]},
    "levels": {"sex": ["F", "M"]}, "penalties": [0.1, 0.05], "lambda_min": 0.05, "lambda_1se": 0.1,
    "coefficients": {"min": {"intercept": -1.1, "beta": [0.25, 0.5]}, "1se": {"intercept": -1.0, "beta": [0.25, 0.0]}},
}


def test_locks_are_named_by_their_content(spark, tmp_path):
    folder = str(tmp_path)
    name = S.write_lock(spark, RECORD, folder)
    assert S.write_lock(spark, dict(reversed(RECORD.items())), folder) == name == S.lock_id(RECORD)
    assert S.read_lock(spark, folder, name, {"m": ("Y", "X")}, {"sex": ("F", "M")}) == RECORD
    for changed in ({"seed": 2}, {"penalties": [0.1, 0.05000000000000001]}, {"terms": ["b", "a"]}, {"levels": {"sex": ["M", "F"]}}):
        assert S.lock_id(RECORD | changed) != name
    with pytest.raises(S.LockMismatch, match="dictionary"):
        S.read_lock(spark, folder, name, {"m": ("X",)})
    with pytest.raises(S.LockMismatch, match="levels"):
        S.read_lock(spark, folder, name, levels={"sex": ("M", "F")})
    with pytest.raises(ValueError, match="lacks"):
        S.write_lock(spark, {"family": "binomial"}, folder)
    spec = S.locked_spec(RECORD, "min")
    assert (spec.intercept, spec.coefficients, spec.model_id) == (-1.1, {"a": 0.25, "b": 0.5}, name)
    part = next((tmp_path / name).glob("part-*"))
    (tmp_path / name / f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace("-1.1", "-1.2"))
    with pytest.raises(S.LockMismatch, match="hash"):
        S.read_lock(spark, folder, name)


def test_buckets_grow_with_the_rows(spark):
    from casewatch.sources import buckets_for

    assert [buckets_for(n) for n in (0, 600_000, 36_000_000, 216_000_000)] == [8, 8, 240, 1440]
