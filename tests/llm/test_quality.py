"""The rule ledger against measurements in plain Python, policies and ablations against filters."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewatch.llm import quality

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x " * 7, "x " * 8, "x " * 9, "x y " * 400,
    "line one two\nline one two\n\n  \nother\nline one two ", "# $ % & | < > *\n" * 3, "- item\n* item\n• item\nplain", "so it goes...\nand on…  \r\nno",
    "ÀÉÎ SHOUTING WORDS IN EVERY LINE OF THIS TEXT HERE AND THERE AND BACK AGAIN WITH MORE AND MORE", "1234 5678 " * 20, "w" * 10_000,
    "a b   c\x1cd\x85e", "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill by the river bank now",
    "p q r s t u v w " + " ".join(f"w{i}" for i in range(3000)) + " p q r s t u v w x",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_letters": sum(c.isalpha() for c in text),
        "n_capitals": sum(c.isupper() for c in text), "n_bullet_lines": sum(bool(re.match("[ \t]*[-*•‣·]", x)) for x in lines),
        "n_ellipsis_lines": sum(bool(re.search("(\\.\\.\\.|…)[ \t\r]*\\Z", x)) for x in lines),
    }
    failed = [
        m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        m["word_chars"] < 3 * m["n_words"] or m["word_chars"] > 12 * m["n_words"], 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        2 * m["n_letters"] < m["word_chars"], 2 * m["n_capitals"] > m["n_letters"], 10 * m["n_bullet_lines"] > 9 * m["n_lines"],
        10 * m["n_ellipsis_lines"] > 3 * m["n_lines"],
    ]
    return (*m.values(), sum(1 << i for i, x in enumerate(failed) if x))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "clash", f"s{i % 2}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[3:4], "doc_id long, text string, words string, source string").repartition(3)


def test_ledger_equals_plain_python(spark, docs, sf_dir):
    rows = quality.ledger(docs, keep=("doc_id", "source", "words")).collect()
    want = Counter((None if i == 5 else i, f"s{i % 2}", "clash", *brute(t)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    assert Counter(tuple(r) for r in rows) == want
    assert quality.ledger(docs.where("false")).collect() == []
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in quality.ledger(real).collect()} == {i: brute(t) for i, t in texts.items()}


def test_columns_with_names_of_measurements(docs):
    clashing = docs.withColumn("n_words", F.lit("x")).withColumn("failed", F.lit("x")).withColumn("lines", F.lit("x"))
    assert quality.ledger(clashing, keep=("doc_id", "lines")).count() == len(TEXTS) + 1
    with pytest.raises(ValueError):
        quality.ledger(clashing, keep=("doc_id", "Failed"))


def test_policies_and_ablations(docs):
    of = quality.ledger(docs, keep=("doc_id", "source")).cache()
    rows = of.collect()
    policies = [quality.BASE, quality.WEB_1, quality.WEB_2]
    for policy in policies:
        kept = Counter(r["doc_id"] for r in quality.verdicts(of, policy).where("kept").collect())
        bits = [i for i, (name, _) in enumerate(quality.RULES) if name in policy.rules]
        assert kept == Counter(r["doc_id"] for r in rows if not any(r["failed"] >> i & 1 for i in bits))
    got = {(r["source"], r["version"], r["rule"]): tuple(r)[3:] for r in quality.ablations(of, policies, by=("source",)).collect()}
    for source in ("s0", "s1"):
        own = [r["failed"] for r in rows if r["source"] == source]
        for p in policies:
            for rule in p.rules:
                bit, others = quality.mask(rule), quality.mask(*(x for x in p.rules if x != rule))
                want = (
                    len(own), sum(f & p.mask == 0 for f in own), sum(f & bit != 0 for f in own), sum(f & p.mask == bit for f in own), sum(f & others == 0 for f in own),
                )
                assert got.pop((source, p.version, rule)) == want
    assert not got
    ever = {r["source"]: (r["n_docs"], r["ever_failed"], r["always_failed"]) for r in quality.coverage(of, ("source",)).collect()}
    for source, (n, some, every) in ever.items():
        own = [r["failed"] for r in rows if r["source"] == source]
        assert n == len(own) and some == __import__("functools").reduce(int.__or__, own) and every == __import__("functools").reduce(int.__and__, own)
    assert quality.ablations(of.where("false"), policies).collect() == []


def test_no_python_in_the_plan(docs):
    plan = quality.verdicts(quality.ledger(docs), quality.WEB_2)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange hash"))
