"""Report table derived from star-schema order tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.session import tune

# Demonstration dictionaries for the derived report table.
DEMO_CLASSES = {"Class A": ("RED", "BLUE"), "Class B": ("OLD",), "Class C": ("GEAR", "RING")}
DEMO_MOLECULES = {
    "red": ("RED WIDGET", "RED GEAR", "RED BOLT"),
    "blue": ("BLUE WIDGET", "BLUE RING"),
    "old": ("OLD ROD", "OLD PLATE", "COLD ROD"),
    "gear": ("HOT GEAR", "NEW GEAR"),
}
DEMO_OUTCOMES = (1, 2, 3, 4)

# Columns read from each table; naming them saves a schema job per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _recode(c: str, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for source, target in reversed(values.items()):
        out = F.when(F.col(c) == source, F.lit(target)).otherwise(out)
    return out


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: case = order, drug = part name, term levels = part attributes.

    Case attributes are joined among themselves first, so that the large side meets them in one
    join on the case id and its partitioning carries into the case-level aggregates.
    """
    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    tune(spark, reports=table("lineitem"))
    nations = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    cases = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    joined = rows.join(cases, F.col("l_orderkey") == F.col("o_orderkey"))
    age = F.when(F.col("o_custkey") % 17 == 0, F.lit("")).otherwise((F.col("o_custkey") % 95).cast("string"))
    return joined.select(
        F.col("l_orderkey").alias("case_id"),
        F.upper("p_name").alias("drug"),
        F.when(F.col("l_linenumber") == 1, "PS")
        .when(F.col("l_linenumber") == 2, "SS")
        .when(F.col("l_linenumber") == 3, "C")
        .otherwise("I").alias("role"),
        F.col("p_size").cast("bigint").alias("pt_code"),
        F.col("p_brand").alias("pt"),
        F.col("p_type").alias("hlt"),
        F.concat("l_returnflag", "l_linestatus").alias("hlgt"),
        F.col("l_returnflag").alias("soc"),
        _recode("c_mktsegment", {"BUILDING": "F", "MACHINERY": "male", "HOUSEHOLD": "2", "AUTOMOBILE": "1"})
        .alias("sex"),
        age.alias("age"),
        _recode("o_orderstatus", {"F": "YR", "O": "MON", "P": ""}).alias("age_unit"),
        F.col("n_name").alias("country"),
        _recode("r_name", {"EUROPE": "EUROPE", "AMERICA": "US", "ASIA": "JAPAN", "MIDDLE EAST": "CHINA"})
        .alias("region"),
        F.when(F.col("o_orderpriority").startswith("1"), "KIDNEY TRANSPLANT")
        .when(F.col("o_orderpriority").startswith("2"), "MIGRAINE")
        .when(F.col("o_orderpriority").startswith("3"), "LUPUS NEPHRITIS")
        .when(F.col("o_orderpriority").startswith("5"), "HYPERTENSION").alias("indication"),
        F.when(F.col("o_orderstatus") == "P", 1).alias("serious_death"),
        F.when(F.col("l_tax") >= 0.07, 1).alias("serious_hospitalization"),
        (F.abs(F.datediff("l_shipdate", "o_orderdate")) % 500).cast("double").alias("tto_days"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("event_dt"),
        F.col("l_quantity").alias("quantity"),
    )
