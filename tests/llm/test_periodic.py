"""Periodic runs against a search of every period, and edge cases."""

import random
from fractions import Fraction

import numpy as np
import pytest

from casewatch.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, collapsed long, n_words string"


def brute_runs(words, least, exponent):
    """All (start, length, period) by trying every period at every start."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute_left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made_texts(seed=5, count=300):
    rng = random.Random(seed)
    for _ in range(count):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (part * 12)[: rng.randint(len(part), 10 * len(part))]
        yield words


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 3), (1, 3), (10, 4)])
def test_runs_equal_brute_force(least, exponent):
    texts = list(made_texts())
    numbers = [np.array([ord(w) for w in t], dtype=np.int64) for t in texts]
    first = np.cumsum([0, *map(len, numbers)])
    runs = periodic.find_runs(np.concatenate(numbers), first, least, exponent)
    for i, words in enumerate(texts):
        inside = [(int(s - first[i]), int(n), int(q)) for s, n, q in runs if first[i] <= s < first[i + 1]]
        assert inside == brute_runs(words, least, exponent)
        own = np.array(inside, dtype=np.int64).reshape(-1, 3)
        assert [words[k] for k in periodic.left_over(len(words), own)] == brute_left(words, inside)


def test_words_of_unlike_bytes_never_count_as_equal():
    """Words that a polynomial hash on one base would confuse, and words beside odd separators."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one = bytes(97 + b for b in bits)
    two = bytes(98 - b for b in bits)
    numbers = periodic.numbered(b" ".join([one, two] * 15), {})
    assert periodic.find_runs(numbers, np.array([0, 30])).tolist() == [[0, 30, 2]]
    assert len(periodic.numbered("a b\x1cc\td\x0be f \n g".encode(), {})) == 4


def test_long_text_is_split_in_parts(monkeypatch):
    raw = b"  alpha beta\tgamma  delta\nepsilon " * 50
    whole = periodic.numbered(raw, {})
    monkeypatch.setattr(periodic, "PART", 7)
    assert (periodic.numbered(raw, {}) == whole).all() and len(whole) == 250
    assert periodic._joined(whole, raw.split()[:5]) == b" ".join(raw.split())


def test_operator_on_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "x " * 23), (5, "x " * 24), (5, "x " * 24), (None, "y z " * 20), (6, "a b c d e f g h i " * 3 + "a"),
        (7, "start " + "p q r " * 9 + "p end"), (8, "w" * 100_000), (9, "one two " * 50_000),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 0, "clash") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = brute_runs(words, 24, 3) if len(words) < 1000 else [(0, 100_000, 2)]
        want.append((i, len(words), runs, " ".join(brute_left(words, runs))))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.where("false")).collect() == []
    assert sorted(r["n_words"] for r in periodic.periodic_runs(docs, order=lambda i, n: np.zeros(min(n, 1), dtype=int)).collect())[-1] == 1
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, dtype=np.int64), np.array([0, 3]), exponent=2)


def test_strongest_is_exact_and_first(spark):
    lists = [[(0, 30, 10), (5, 24, 8), (9, 30, 10)], [], [(0, 25, 8), (1, 100_000_001, 32_000_000), (2, 25, 8)], [(4, 50, 10), (4, 60, 12)]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k long, runs array<struct<start:long,length:long,period:long>>")
    got = {r[0]: r[1] and tuple(r[1]) for r in frame.select("k", periodic.strongest(frame["runs"]).alias("best")).collect()}
    want = {i: min(x, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if x else None for i, x in enumerate(lists)}
    assert got == want


def test_loops_follow_the_rule():
    import zlib

    looped = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    g = zlib.crc32(str(looped).encode()) // 10
    a, p = g % 500, 1 + (500 - g % 500) // (3 + g % 8)
    assert queries.looped(looped, 500).tolist() == [i if i < a else a + (i - a) % p for i in range(500)]
    assert queries.looped(plain, 500) is None and queries.looped(looped, 0) is None and queries.looped(None, 9) is None
