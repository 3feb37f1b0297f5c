"""2x2 counts and disproportionality tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions.metrics import with_metrics
from casewatch.functions.numbers import order_key
from casewatch.functions.text import match, norm_text
from casewatch.operators.exposure import (
    Dictionary, drug_exposures, exposed_flags, flag_labels, in_roles, long_form,
)
from casewatch.session import cut_lineage

TERM_COLUMNS = {"SOC": "soc", "HLGT": "hlgt", "HLT": "hlt", "PT": "pt"}


def normalised(reports: DataFrame) -> DataFrame:
    """Drug, role and term columns in normal form, nothing else kept but the case."""
    columns = [c for c in ("role", "drug", *TERM_COLUMNS.values()) if c in reports.columns]
    return reports.select("case_id", *[norm_text(c).alias(c) for c in columns])


def case_terms(reports: DataFrame, levels: Mapping[str, str] = TERM_COLUMNS) -> DataFrame:
    """Distinct (case_id, level, term) over all hierarchy levels in one scan; empty terms dropped."""
    entries = [F.struct(F.lit(k).alias("level"), F.col(c).alias("term")) for k, c in levels.items()]
    return (
        reports.select("case_id", F.inline(F.array(*entries))).filter(F.length("term") > 0).distinct()
    )


@dataclass(frozen=True)
class SignalTables:
    """What the counts of an exposure mode read.

    `case_terms`: distinct (case_id, level, term); `pairs`: (case_id, drug) of drugs that the dictionary names, in the
    wanted roles; `n_cases`: the number of all cases, as a column.
    """

    case_terms: DataFrame
    pairs: DataFrame
    n_cases: Column


def signal_tables(
    reports: DataFrame,
    dictionary: Dictionary,
    levels: Mapping[str, str] = TERM_COLUMNS,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> SignalTables:
    """The tables of one mode as parts of its plan: each is read once, so nothing is written."""
    words = [word for words in dictionary.values() for word in words]
    pairs = reports.filter(in_roles(roles) & match("drug", words, how)).select("case_id", "drug")
    return SignalTables(case_terms(reports, levels), pairs, _total(reports.select("case_id").distinct()))


def written_signal_tables(
    reports: DataFrame,
    dictionary: Dictionary,
    levels: Mapping[str, str] = TERM_COLUMNS,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> SignalTables:
    """The same for several modes, written to the shared folder: each is derived from the reports once."""
    entries = [F.struct(F.lit(k).alias("level"), F.col(c).alias("term")) for k, c in levels.items()]
    case = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("term"))
    # one row without a level for each case, also for those without a term
    terms = reports.select("case_id", F.inline(F.array(*entries, case))).filter(
        F.col("level").isNull() | (F.length("term") > 0)
    )
    terms = cut_lineage(terms.distinct())
    pairs = cut_lineage(signal_tables(reports, dictionary, levels, how, roles).pairs.distinct())
    return SignalTables(terms.filter(F.col("level").isNotNull()), pairs, _total(terms.filter(F.col("level").isNull())))


def _total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).cast("bigint")).scalar()


def _cells(comparator: str, n_exposed_term: str, n_term: str, n_any_term: str, n_exposed: str, n_any: str,
           n_cases: str) -> list[Column]:
    a, exposed = F.col(n_exposed_term), F.col(n_exposed)
    if comparator == "rest":
        b, others = F.col(n_term) - a, F.col(n_cases) - exposed
    elif comparator == "unexposed":
        b, others = F.col(n_term) - F.col(n_any_term), F.col(n_cases) - F.col(n_any)
    else:
        raise ValueError(f"comparator must be 'rest' or 'unexposed', not {comparator!r}")
    return [a.alias("a"), b.alias("b"), (exposed - a).alias("c"), (others - b).alias("d")]


def class_counts(
    reports: DataFrame,
    dictionary: Dictionary,
    comparator: str = "rest",
    include_zero: bool = False,
    levels: Mapping[str, str] = TERM_COLUMNS,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    tables: SignalTables | None = None,
) -> DataFrame:
    """Class x term counts for all levels: (level, exposure, signal_term, a, b, c, d).

    Exposure is held as one 0/1 column per class, so the term rows are joined to the exposed cases once
    and summed per term. Non-exposed and non-event cells come from the margins, so no absent pair is
    ever formed. `tables` takes those of the same dictionary, levels, match and roles.
    """
    tables = tables or signal_tables(reports, dictionary, levels, how, roles)
    exposed = exposed_flags(tables.pairs, dictionary, how, None)
    labels = flag_labels(dictionary)
    margins = exposed.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_any"),
            *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in labels],
        )
    ).scalar()
    per_term = (
        tables.case_terms
        .join(exposed.withColumn("_any", F.lit(1)), "case_id", "left")
        .groupBy("level", "term")
        .agg(
            F.count(F.lit(1)).alias("n_term"),
            F.count("_any").alias("n_any_term"),
            *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in labels],
        )
        .withColumn("_m", margins)
        .withColumns({"n_cases": tables.n_cases, "n_any": F.col("_m.n_any")})
    )
    long = long_form(
        per_term,
        ["level", "term", "n_term", "n_any_term", "n_cases", "n_any"],
        labels,
        {"n_exposed_term": lambda f: F.col(f), "n_exposed": lambda f: F.col("_m").getField(f)},
    )
    counts = long.select(
        "level", "exposure", F.col("term").alias("signal_term"),
        *_cells(comparator, "n_exposed_term", "n_term", "n_any_term", "n_exposed", "n_any", "n_cases"),
    )
    return counts if include_zero else counts.filter("a > 0")


def drug_counts(
    reports: DataFrame,
    dictionary: Dictionary,
    comparator: str = "rest",
    levels: Mapping[str, str] = TERM_COLUMNS,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    min_cases: int = 1,
    tables: SignalTables | None = None,
) -> DataFrame:
    """Drug name x term counts of the observed pairs, same columns as `class_counts`.

    Both sides are distinct before the join on the case, so one case adds at most one row per pair of
    the result, however many report rows it has.
    """
    tables = tables or signal_tables(reports, dictionary, levels, how, roles)
    exposures = drug_exposures(tables.pairs, dictionary, how, None)
    # One exposure per case is marked, so that sums over exposures can also count the case once.
    marked = exposures.withColumn(
        "_once", F.row_number().over(Window.partitionBy("case_id").orderBy("exposure")) == 1
    )
    per_drug = exposures.groupBy("exposure").agg(F.count(F.lit(1)).alias("n_exposed"))
    once = F.count_if(F.coalesce("_once", F.lit(True)))
    in_term = Window.partitionBy("level", "term")
    pairs = (
        tables.case_terms
        .join(marked, "case_id", "left")
        .groupBy("level", "exposure", "term")
        .agg(F.count(F.lit(1)).alias("n_exposed_term"), once.alias("_cases"))
        .withColumns({
            "n_term": F.sum("_cases").over(in_term),
            "n_any_term": F.sum(F.when(F.col("exposure").isNotNull(), F.col("_cases")).otherwise(0)).over(in_term),
        })
        .filter(F.col("exposure").isNotNull())
    )
    n_any = _total(exposures.select("case_id").distinct()) if comparator == "unexposed" else F.lit(0)
    joined = pairs.join(per_drug.filter(F.col("n_exposed") >= min_cases), "exposure").withColumns(
        {"n_cases": tables.n_cases, "n_any": n_any}
    )
    return joined.select(
        "level", "exposure", F.col("term").alias("signal_term"),
        *_cells(comparator, "n_exposed_term", "n_term", "n_any_term", "n_exposed", "n_any", "n_cases"),
    )


def signal_table(counts: DataFrame, exposure_level: str, min_cell: int | None = None) -> DataFrame:
    """Measures over event-major counts; `min_cell` keeps rows with at least that many exposed events."""
    kept = counts if min_cell is None else counts.filter(F.col("a") >= min_cell)
    measured = with_metrics(kept, "event_major")
    return measured.select(
        "level", F.lit(exposure_level).alias("exposure_level"), "exposure", "signal_term", "N",
        "a", "b", "c", "d", "ROR", "LCL_ROR", "UCL_ROR", "PRR", "chi2",
    )


def ordered_signals(table: DataFrame, exposure_order: Sequence[str]) -> DataFrame:
    return table.orderBy(
        order_key("exposure", exposure_order), F.desc_nulls_last("ROR"), F.desc_nulls_last("chi2"), "signal_term"
    )


def signal_index(
    reports: DataFrame, dictionary: Dictionary, class_options: Mapping | None = None, drug_options: Mapping | None = None, **options
) -> DataFrame:
    """All levels and both exposure modes in one table, tagged '<level>-Class' / '<level>-Drug'.

    `options` go to both modes, `class_options` and `drug_options` to one. Modes that agree on levels, match and
    roles share their written tables.
    """
    for_class, for_drug = {**options, **(class_options or {})}, {**options, **(drug_options or {})}

    def written(given: Mapping) -> dict:
        return {k: given[k] for k in ("levels", "how", "roles") if k in given}

    shared = written_signal_tables(reports, dictionary, **written(for_class))
    same = written(for_class) == written(for_drug)
    other = shared if same else written_signal_tables(reports, dictionary, **written(for_drug))
    classes = signal_table(class_counts(reports, dictionary, tables=shared, **for_class), "Class")
    drugs = signal_table(drug_counts(reports, dictionary, tables=other, **for_drug), "Drug")
    both = classes.unionByName(drugs, allowMissingColumns=True)
    return both.withColumn("level", F.concat_ws("-", "level", "exposure_level"))


def stratified_counts(
    cases: DataFrame,
    labels: Mapping[str, str],
    strata: Sequence[str],
    outcome: str = "outcome",
) -> DataFrame:
    """Exposure-major 2x2 counts per exposure and stratum: (exposure, strata..., a, b, c, d).

    One aggregate over the case table with two sums per flag; rows are only multiplied by the number
    of exposures after aggregation.
    """
    y = F.col(outcome)
    sums = {f"_e_{f}": F.sum(F.col(f)) for f in labels} | {f"_a_{f}": F.sum(F.col(f) * y) for f in labels}
    wide = cases.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"),
        *[c.cast("bigint").alias(name) for name, c in sums.items()],
    )
    long = long_form(
        wide, [*strata, "_n", "_y"], labels,
        {"_e": lambda f: F.col(f"_e_{f}"), "a": lambda f: F.col(f"_a_{f}")},
    )
    return long.select(
        "exposure", *strata, "a",
        (F.col("_e") - F.col("a")).alias("b"),
        (F.col("_y") - F.col("a")).alias("c"),
        (F.col("_n") - F.col("_e") - F.col("_y") + F.col("a")).alias("d"),
    )


def stratified_grid(
    cases: DataFrame, labels: Mapping[str, str], sets: Sequence[Sequence[str]], outcome: str = "outcome"
) -> DataFrame:
    """`stratified_counts` of several stratifications at once: (exposure, stratification, all strata columns, a, b, c, d).

    The case table is aggregated once, to the cells of all strata together; the grouping sets run over these few
    cells. A strata column is null where it is not part of the row's stratification; cases without a label of a
    stratification are not part of it.
    """
    strata = list(dict.fromkeys(c for s in sets for c in s))
    y = F.col(outcome)
    sums = {f"_e_{f}": F.col(f) for f in labels} | {f"_a_{f}": F.col(f) * y for f in labels}
    cells = cases.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    totals = [F.sum(c).cast("bigint").alias(c) for c in ("_n", "_y", *sums)]
    missing = [F.max((F.grouping(c) == 0) & F.col(c).isNull()).alias(f"_m_{c}") for c in strata]
    wide = cells.groupingSets([[F.col(c) for c in s] for s in sets], *strata).agg(F.grouping_id().alias("_set"), *totals, *missing)
    bits = {c: 1 << (len(strata) - 1 - i) for i, c in enumerate(strata)}
    names = {sum(b for c, b in bits.items() if c not in s): " x ".join(s) for s in sets}
    name = F.coalesce(*[F.when(F.col("_set") == k, F.lit(v)) for k, v in names.items()])
    complete = wide.where(~reduce(or_, [F.col(f"_m_{c}") for c in strata])).withColumn("stratification", name)
    long = long_form(
        complete, ["stratification", *strata, "_n", "_y"], labels,
        {"_e": lambda f: F.col(f"_e_{f}"), "a": lambda f: F.col(f"_a_{f}")},
    )
    return long.select(
        "exposure", "stratification", *strata, "a",
        (F.col("_e") - F.col("a")).alias("b"),
        (F.col("_y") - F.col("a")).alias("c"),
        (F.col("_n") - F.col("_e") - F.col("_y") + F.col("a")).alias("d"),
    )


def roll_up(counts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Sum a finer grid of counts over the strata left out."""
    return counts.groupBy("exposure", *strata).agg(*[F.sum(x).cast("bigint").alias(x) for x in "abcd"])


def stratified_signals(counts: DataFrame) -> DataFrame:
    return with_metrics(counts, "exposure_major")


def ordered_strata(
    table: DataFrame, exposure_order: Sequence[str], stratum: str, stratum_order: Sequence[str]
) -> DataFrame:
    return table.orderBy(order_key("exposure", exposure_order), order_key(stratum, stratum_order))
