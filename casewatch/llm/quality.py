"""Quality rules as a ledger of failure bits: rules are evaluated once, policies are masks applied to the bits.

`ledger` measures every text once and sets one bit of `failed` per rule that the text fails. A policy is a version
with the rules it enforces; `verdicts` applies it to a written ledger by one bitwise AND, without touching the texts,
and `ablations` says what each rule of each policy adds, from the counts of the distinct bit sets.

DataFrame functions only. Each text is measured inside its row: no shuffle, no exploded words; what a row needs grows
with its own text. Repeated windows are found by sorting the (hash, place) pairs of a text whose window hashes are
not all different; two different windows of one text are taken for equal only if their 64-bit hashes meet.

Null text counts as empty: it has no words and fails `few_words` only. Rows are kept one for one, repeated rows and null
ids included; columns of the input other than the kept ones have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W

# White space between words, symbols that are counted, the words of a window.
BETWEEN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_bullet_lines", "n_ellipsis_lines")

# Name and failure condition over the measurements; the place in the list is the bit. New rules are added at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the filter: a text is kept if it fails none of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask(*self.rules)


def mask(*rules: str) -> int:
    """The bits of the named rules."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in set(rules))


BASE = Policy("base-1", ("few_words", "repeated_words"))
WEB_1 = Policy("web-1", (*BASE.rules, "symbols", "repeated_lines"))
WEB_2 = Policy("web-2", (*WEB_1.rules, "word_length", "few_letters", "capitals", "bullets", "ellipses"))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """How many words the windows that start at these ascending places cover."""
    steps = _let(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), x - F.get(p, k - 1)), F.lit(WINDOW))))
    return F.reduce(steps, F.lit(0), lambda total, step: total + step)


def _repeated_places(hashes: Column) -> Column:
    """Ascending places of the windows whose hash occurs again."""
    marked = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    again = lambda s: F.filter(
        s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    )
    return F.sort_array(F.transform(_let(marked, again), lambda x: x["at"]))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the measurements (long) and `failed` (long): bit i is set if rule i fails.

    A kept column of the name of a measurement gives an error, as its meaning would not be clear.
    """
    if clash := {k.lower() for k in keep} & {*MEASURES, "failed"}:
        raise ValueError(f"columns {sorted(clash)} are made here: rename those of the table")
    text, words, hashes, windows, lines = (W.fresh_name(docs, x) for x in ("text", "words", "hashes", "windows", "lines"))
    c = F.col
    named = docs.select(*keep, F.coalesce(c(text_col).cast("string"), F.lit("")).alias(text))
    split = named.select(
        *keep, text,
        F.array_remove(F.split(text, BETWEEN), "").alias(words),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    hashed = split.select(*keep, text, words, lines, F.transform(words, lambda w: F.xxhash64(w)).alias(hashes))
    n = F.size(words)
    window = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW)))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    windowed = hashed.select(*keep, text, words, lines, F.transform(starts, window).alias(windows))
    different = F.size(F.array_distinct(windows)) == F.size(windows)
    measured = windowed.select(
        *keep,
        *(m.cast("long").alias(name) for name, m in {
            "n_words": n,
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when((n < WINDOW) | different, F.lit(0)).otherwise(_covered(_repeated_places(c(windows)))),
            "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_bullet_lines": F.size(F.filter(lines, lambda line: line.rlike("^[ \t]*[-*•‣·]"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda line: line.rlike("(\\.\\.\\.|…)[ \t\r]*$"))),
        }.items()),
    )
    bits = (F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES))
    failed = next(bits)
    for bit in bits:
        failed = failed.bitwiseOR(bit)
    return measured.select("*", failed.cast("long").alias("failed"))


def fails(rules_mask: int, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(rules_mask)) != 0


def verdicts(of: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `policy` (its version) and `kept`."""
    return of.select("*", F.lit(policy.version).alias("policy"), (~fails(policy.mask)).alias("kept"))


def ablations(of: DataFrame, policies: list[Policy], by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of each policy does: (by..., version, rule, n_docs, n_kept, n_failed, n_only, n_kept_without).

    n_only: documents that fail this rule and no other of the policy; n_kept_without: kept if the rule were left out.
    Rows with equal bits are counted first, so what meets the policies is at most 2 ** rules rows a group.
    """
    counted = of.groupBy(*by, "failed").agg(F.count(F.lit(1)).alias("n"))
    names = [name for name, _ in RULES]
    cases = F.array(*(
        F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for p in policies for r in p.rules
    ))
    rows = counted.select(*by, "failed", "n", F.explode(cases).alias("case")).select(*by, "failed", "n", "case.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy(*by, "version", "rule").agg(
        F.sum("n").alias("n_docs"), total(hit == 0).alias("n_kept"), total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"), total((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )


def coverage(of: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_docs, ever_failed, always_failed): the rules that some, and that all, documents of a group fail."""
    return of.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.bit_or("failed").alias("ever_failed"), F.bit_and("failed").alias("always_failed"))
