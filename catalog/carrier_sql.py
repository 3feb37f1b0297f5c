"""The derived report table as SQL: the same columns as `casewatch.plans.carrier.report_table`."""

import re

from casewatch import defaults as D

CARRIER = """
WITH m AS (
  SELECT l_orderkey AS case_id, upper(p_name) AS drug,
         CASE l_linenumber WHEN 1 THEN 'PS' WHEN 2 THEN 'SS' WHEN 3 THEN 'C' ELSE 'I' END AS role,
         CAST(p_size AS BIGINT) AS pt_code,
         p_brand AS pt, p_type AS hlt, l_returnflag || l_linestatus AS hlgt, l_returnflag AS soc,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'MACHINERY' THEN 'male' WHEN 'HOUSEHOLD' THEN '2'
              WHEN 'AUTOMOBILE' THEN '1' END AS sex,
         CASE WHEN o_custkey % 17 = 0 THEN '' ELSE CAST(o_custkey % 95 AS VARCHAR) END AS age,
         CASE o_orderstatus WHEN 'F' THEN 'YR' WHEN 'O' THEN 'MON' WHEN 'P' THEN '' END AS age_unit,
         n_name AS country,
         CASE r_name WHEN 'EUROPE' THEN 'EUROPE' WHEN 'AMERICA' THEN 'US' WHEN 'ASIA' THEN 'JAPAN'
              WHEN 'MIDDLE EAST' THEN 'CHINA' END AS region,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'KIDNEY TRANSPLANT' WHEN '2' THEN 'MIGRAINE'
              WHEN '3' THEN 'LUPUS NEPHRITIS' WHEN '5' THEN 'HYPERTENSION' END AS indication,
         CASE WHEN o_orderstatus = 'P' THEN 1 END AS serious_death,
         CASE WHEN l_tax >= 0.07 THEN 1 END AS serious_hospitalization,
         CAST(abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 500 AS DOUBLE) AS tto_days,
         strftime(o_orderdate, '%Y%m%d') AS event_dt,
         l_quantity AS quantity
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

NORM = r"trim(regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9+\-]+', ' ', 'g'))"

TRANSPLANT, AUTOIMMUNE = (f"({'|'.join(words)})" for words in (D.TRANSPLANT_WORDS, D.AUTOIMMUNE_WORDS))

# Age bands with the closed range of years of each.
AGE_BANDS = "(VALUES ('<18', 0, 18), ('18-39', 18, 39), ('40-64', 40, 64), ('65+', 65, 'infinity'::DOUBLE)) bands(label, low, high)"


def band_of(age: str) -> str:
    """The band of a positive age: of two that share a border, the later one; none between bands."""
    return f"(SELECT arg_max(label, low) FROM {AGE_BANDS} WHERE {age} > 0 AND {age} BETWEEN low AND high)"


def by_value(sql: str) -> str:
    """The same query with one value of a case, by text hash, in place of its smallest level."""
    raw = {"sx": "sex", "sx2": "sex", "rg": "region", "ig": "indication"}
    return re.sub(
        r"min\((CASE(?:(?!min\().)*END)\) AS (sx2?|rg|ig)\b",
        lambda m: f"min(CAST('0x' || substr(md5({raw[m[2]]}), 1, 8) AS BIGINT) * 16 + {m[1]}) % 16 AS {m[2]}", sql, flags=re.DOTALL,
    )


# The demonstration dictionaries in SQL.
CLASS_TESTS = {
    "flag_class_a": "(drug LIKE '%RED%' OR drug LIKE '%BLUE%')",
    "flag_class_b": "(drug LIKE '%OLD%')",
    "flag_class_c": "(drug LIKE '%GEAR%' OR drug LIKE '%RING%')",
}
CLASS_LABELS = {"flag_class_a": "Class A", "flag_class_b": "Class B", "flag_class_c": "Class C"}
CLASS_ROWS = "(VALUES ('Class A', 'RED'), ('Class A', 'BLUE'), ('Class B', 'OLD'), ('Class C', 'GEAR'), ('Class C', 'RING'))"
MOLECULE_TESTS = {
    "flag_mol_red": "drug IN ('RED WIDGET', 'RED GEAR', 'RED BOLT')",
    "flag_mol_blue": "drug IN ('BLUE WIDGET', 'BLUE RING')",
    "flag_mol_old": "drug IN ('OLD ROD', 'OLD PLATE', 'COLD ROD')",
    "flag_mol_gear": "drug IN ('HOT GEAR', 'NEW GEAR')",
}
OUTCOME = "pt_code IN (1, 2, 3, 4)"


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def flag_list(tests: dict[str, str], condition: str = "role IN ('PS', 'SS')") -> str:
    return ", ".join(
        f"max(CASE WHEN {condition} AND {test} THEN 1 ELSE 0 END) AS {name}" for name, test in tests.items()
    )


def flags_sql(source: str = "m", tests: dict[str, str] = CLASS_TESTS, condition: str = "role IN ('PS', 'SS')") -> str:
    return f"SELECT case_id, {flag_list(tests, condition)} FROM {source} GROUP BY case_id"


def stacked(select: str, source: str, labels: dict[str, str] = CLASS_LABELS) -> str:
    """The reference form of a long table: one block per flag, united."""
    return " UNION ALL ".join(
        f"SELECT '{label}' AS exposure, {select.replace('FLAG', flag)} FROM {source} WHERE {flag} = 1"
        for flag, label in labels.items()
    )
