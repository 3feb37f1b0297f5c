"""Hashes of words and runs against plain definitions and known hard cases."""

import numpy as np

from casewatch.llm import near_dedup
from casewatch.llm import words as W


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def split(*texts, **options):
    raw = [t.encode() for t in texts]
    return W.split(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), **options)


def test_products_and_runs_modulo_the_prime():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, W.PRIME, 2000, dtype=np.uint64) for _ in range(2))
    edge = np.array([0, 1, W.PRIME - 1, W.PRIME - 2, 1 << 60], dtype=np.uint64)
    a, b = np.concatenate([a, edge, edge]), np.concatenate([b, edge, edge[::-1]])
    assert W._times(a, b).tolist() == [int(x) * int(y) % W.PRIME for x, y in zip(a, b)]
    hashes = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    hashes[1500:1600] = hashes[100:200]
    starts, ends = np.array([100, 1500, 100, 0, 7]), np.array([200, 1600, 201, 3000, 7])
    one, two, three, four, none = W.run_identities(hashes, starts, ends).tolist()
    assert one == two and len({one, three, four, none}) == 4
    base = [pow(W._PRIME_BASE, i, W.PRIME) for i in range(100)]
    plain = sum(int(h) % W.PRIME * p for h, p in zip(hashes[100:200], base)) % W.PRIME
    assert one == int(W.mix(np.array([plain], dtype=np.uint64), 13)[0])


def test_long_regular_words_differ():
    one = "".join("ab"[i] for i in thue_morse(4096))
    two = "".join("ba"[i] for i in thue_morse(4096))
    assert len(set(split(f"{one} {two} {one}").hashes.tolist())) == 2
    assert split(one.upper(), lower=True).hashes.tolist() == split(one).hashes.tolist()
    assert split("x " + one).hashes[1] == split(one).hashes[0]


def test_long_regular_texts_are_no_copies(spark):
    one = " ".join(("red", "blue")[i] for i in thue_morse(4096))
    two = " ".join(("blue", "red")[i] for i in thue_morse(4096))
    words = split(one, two)
    a, b = words.first[:-1], words.first[1:]
    assert len(set(W.run_hashes(W.prefix_sums(words.hashes), a, b).tolist())) == 1  # why the second one is needed
    assert len(set(W.run_identities(words.hashes, a, b).tolist())) == 2
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    rows = near_dedup.signatures(docs, 2, 2, "doc_id", "text").collect()
    same = {r["doc_id"]: (r["same"], r["same2"]) for r in rows}
    assert same[1] == same[3] != same[2]
