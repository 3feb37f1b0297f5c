"""Text operators against brute force, the reference tokenizer, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casewatch.llm import bpe, extraction, language_model, near_dedup, packing, queries, substring, token_counts, toxicity
from casewatch.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "no id " * 60), (5, "a" * 5000), (6, "word " * 4000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())


def test_bpe_equals_the_tokenizer_and_decodes(spark, docs, odd, none):
    tokenizer = reference_tokenizer()
    rng = random.Random(3)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "é", "中文", "१२", "'ll", "<|endoftext|>", " ", "\x1c", "😀", "a" * 40, "..."]
    made = [(1000 + i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(300)]
    all_docs = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {(r[0], r[1]) for r in all_docs.collect()}
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    got = {tuple(r) for r in bpe.round_trip(all_docs, queries.vocabulary_path()).collect()}
    assert got == set(want)
    encoded = bpe.encode(all_docs, queries.vocabulary_path())
    assert {(r[0], r[1]) for r in bpe.decode(encoded, queries.vocabulary_path()).collect()} == {(i, t or "") for i, t in texts}
    assert bpe.round_trip(none, queries.vocabulary_path()).count() == 0


def test_packing_places_every_piece_once(docs, odd, none):
    tokenizer = reference_tokenizer()
    rows = packing.pack_documents(docs.union(odd), queries.vocabulary_path(), keep={"ids": F.col("ids")}).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.02 * -(-total // packing.CAPACITY) + 1
    own = {4, 5, 6, 1, 2, 3}  # ids that both tables use
    for doc_id, text in [(r[0], r[1]) for r in docs.select("doc_id", "text").limit(60).collect() if r[0] not in own]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        found = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert all(r["length"] == packing.CAPACITY for r in found[1:]) and sum(r["length"] for r in found) == len(ids)
        for r in found:
            part = b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]])
            assert part == r["ids"]
    empty = packing.document_pieces(none, queries.vocabulary_path())
    assert empty.count() == 0 and packing.pack(empty).count() == 0 and packing.sequences(empty).count() == 0


def test_sequences_hold_whole_pieces_without_gaps(spark, docs, odd, monkeypatch):
    pieces = packing.document_pieces(docs.union(odd), queries.vocabulary_path(), 256)
    own = defaultdict(list)
    for r in pieces.collect():
        own[r["doc_id"], r["piece"]].append(bytes(r["ids"]))
    rows = packing.sequences(pieces, 256).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        at = 0
        for offset, length, doc_id, piece in r["pieces"]:
            assert offset == at
            at += length
            own[doc_id, piece].remove(bytes(r["ids"])[4 * offset : 4 * at])
        assert at == r["length"] <= 256 and len(r["ids"]) == 4 * at
    assert not any(own.values())
    monkeypatch.setattr(queries, "table", lambda *_: docs.union(odd))
    digests = queries.op1_best_fit_packing(spark, "")
    assert digests.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = packing.document_pieces(docs.union(odd), queries.vocabulary_path())
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"])
    want = [{**r.asDict(), "ids_crc32": zlib.crc32(bytes(r["ids"]))} for r in whole.collect()]
    assert sorted(map(key, digests.collect())) == sorted(map(key, want))


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(90)) for c in "xy")
    rows = [(9, one), (9, two), (5, one), (12, two + " end"), (13, "alone " * 7), (None, one), (None, None), (14, None)]
    frame = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, node string, label long, n long")
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(frame.repartition(3)).collect())
    assert got == Counter([(9, 5), (9, 5), (5, 5), (12, 9), (13, 13), (None, None), (None, None), (14, 14)])


def test_plan_holds_each_length_once():
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        seen = Counter()
        patterns = packing.plan(counts, 64)
        for pattern, times in patterns:
            assert sum(pattern) <= 64 and times > 0
            for length in pattern:
                seen[length] += times
        assert seen == Counter(counts)
    assert packing.plan({32: 2, 16: 2, 64: 1}, 64) == [((64,), 1), ((32, 32), 1), ((16, 16), 1)] and packing.plan({}, 64) == []


def brute_removed(rows, window):
    first, words = {}, {}
    for k, (doc_id, text) in enumerate(rows):
        words[k] = (text or "").encode().split()
        if doc_id is not None:
            for i in range(len(words[k]) - window + 1):
                passage = tuple(words[k][i : i + window])
                first[passage] = min(first.get(passage, doc_id), doc_id)
    out = Counter()
    for k, (doc_id, _) in enumerate(rows):
        gone = set()
        for i in range(len(words[k]) - window + 1):
            if doc_id is not None and first[tuple(words[k][i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words[k]) if i not in gone]
        out[(doc_id, len(words[k]), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def test_substring_against_brute_force(spark, docs, odd, none):
    rng = random.Random(5)
    shared = [[f"w{rng.randint(0, 9)}" for _ in range(60)] for _ in range(3)]
    rows = [(20000 + i, " ".join(rng.choice(shared)[: rng.randint(3, 60)] + [f"x{i}"] + rng.choice(shared)[rng.randint(0, 50) :])) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for frame, window in ((docs.select("doc_id", "text").union(odd.select("doc_id", "text")), 50), (made, 8)):
        want = brute_removed([(r[0], r[1]) for r in frame.collect()], window)
        assert Counter(tuple(r) for r in substring.digests(frame, window).collect()) == want
    assert substring.digests(none).count() == 0


def test_cleaned_keeps_columns_and_untouched_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    frame = spark.createDataFrame([(1, passage + "\n end", "en", 7), (2, "start " + passage, "de", 8), (3, "a\nb", "fr", 3)], "doc_id long, text string, blocks string, n_chars int")
    rows = {r["doc_id"]: r for r in substring.cleaned(frame).collect()}
    assert rows[1]["text"] == passage + "\n end" and rows[1]["n_chars"] == 7
    assert (rows[2]["text"], rows[2]["blocks"], rows[2]["n_chars"]) == ("start", "de", 5) and rows[3]["text"] == "a\nb"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_plain_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        b = [x for x in a if rng.random() > 0.06]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 30))
        m = lcs(a, b)
        exact = m / (len(a) + len(b) - m)
        assert near_dedup.aligned(a, b) == pytest.approx(exact if exact >= 0.8 - 1e-9 else 0.0)


def test_near_duplicates_find_planted_copies(spark, odd, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(200)]
        for c in range(5):
            text = base[:]
            for _ in range(c % 3):
                text[rng.randint(0, 199)] = word()
            group[g * 5 + c] = g * 5
            rows.append((100 + g * 5 + c, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {100 + i: 100 + g for i, g in group.items()}
    rest = Counter(tuple(r) for r in near_dedup.near_duplicates(odd).collect())
    assert rest == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, None), (5, 5), (6, 6)])
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_short_texts_against_brute_force(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts, line = [], [word() for _ in range(10)]
    for n in [*range(5, 21), 30, 45, 60, 68, 80, 84] * 6:
        base = [word() for _ in range(n)]
        texts += [base, base + [word()], [word(), *base], [*base, word(), word()], base[: n - n // 8], line + base]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in near_dedup.near_duplicates(frame).collect()}
    grams = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    want = list(range(len(texts)))
    for i in range(0, len(texts), 6):  # copies of one base; line + base differ from other bases by more than is allowed
        for a in range(i, i + 6):
            for b in range(a + 1, i + 6):
                x, y = grams[a], grams[b]
                if texts[a] == texts[b] or x and y and near_dedup.aligned(x, y) >= 0.8:
                    low, high = sorted((want[a], want[b]))
                    want = [low if w == high else w for w in want]
    assert got == dict(enumerate(want))


def test_toxicity_on_held_out_rows(spark, odd, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        text = [f"w{rng.randint(0, 400)}" for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for w in rng.sample(["idiot", "moron", "scum"], 2):
                text.insert(rng.randint(0, 39), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad) if i % 17 else None))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, marks, lambda c: queries.fold(c) == 0, bits=18)
    scores = {r[0]: r[1] for r in toxicity.scored(frame, model, 18, keep=["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert len(model[0]) < 1000
    extra = odd.withColumn("score", F.lit("kept"))
    assert toxicity.scored(extra, model, 18).count() == len(ODD) and toxicity.scored(none, model, 18).count() == 0
    unlearned = toxicity.fit(none, marks, lambda c: queries.fold(c) == 0, bits=18)
    assert toxicity.scored(odd, unlearned, 18).select(F.max(F.col("score"))).first()[0] == pytest.approx(0.01)


def test_language_model_is_normalised_and_beats_the_base(spark, none, odd):
    rows = [(1, "a b a b c"), (2, "a b b"), (3, "c a b"), (4, None), (5, "A B")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.train(frame)
    assert model.tokens == 5 + 3 + 3 + 0 + 2 + 5 and model.vocabulary == 4
    context = ["", "a", "b", "c", "zzz"]
    asked = [(i, f"{c} {w}".strip()) for i, (c, w) in enumerate((c, w) for c in context for w in ["", "a", "b", "c", "unknown"])]
    scored = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert all(r["score"] < 0 and r["n_tokens"] >= r["n_known"] for r in scored.values())
    one_word = {t: 10 ** language_model.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model, ["doc_id"]).first()["score"] for t in ("", "a")}
    assert one_word[""] + one_word["a"] < 1
    plain = language_model.score(frame, model, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert plain[0] > plain[1]
    empty = language_model.train(none)
    assert language_model.score(odd, empty, ["doc_id"]).count() == len(ODD)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-notice">We use cookies.</div>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, really.</div><article><h1>Title &amp; more</h1>
<p>First   paragraph, with <b>bold</b> text.<p>Second one.<ul><li>point</ul><script>x("</p>")</script></article>
<section id="comments"><p>A reader says something long, and more, and more.</p></section><form><p>mail</p></form><footer>Imprint</footer></body></html>"""


def test_language_model_keeps_words_apart_that_share_forty_bits(spark):
    # found by trial: the last 40 bits of both hashes are equal
    model = language_model.train(spark.createDataFrame([(1, "ituoca cgkfba")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "ituoca"), (2, "feefda"), (3, "cgkfba"), (4, "ykqtca")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in language_model.score(asked, model, ["doc_id"]).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1}  # the end token is known
    assert language_model.train(asked).vocabulary == 5


def test_extraction(spark):
    schema = "page_id long, url string, html string, text string"
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, ""), (3, "v", "", ""), (4, "w", "<div><p>Only &lt;this&gt;, here.<!-- no -->", "")], schema)
    rows = {r["page_id"]: r for r in extraction.extract(frame).collect()}
    assert rows[1]["text"] == "Title & more\nFirst paragraph, with bold text.\nSecond one.\npoint"
    assert rows[2]["text"] == rows[3]["text"] == "" and rows[4]["text"] == "Only <this>, here."
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_token_totals_are_additive_and_idempotent(spark, tmp_path):
    kept = token_counts.TokenTotals(spark, str(tmp_path / "totals"))
    rows = spark.createDataFrame([("s", "en", "v1", 3), ("s", None, "v1", None)], "source string, lang string, tokenizer string, n_tokens long")
    assert kept.commit("a", token_counts.inserts(rows)) and not kept.commit("a", token_counts.inserts(rows))
    changed = spark.createDataFrame([("s", "en", "v1", 3, "s", "de", "v2", 5)], "old_source string, old_lang string, old_tokenizer string, old_n_tokens long, new_source string, new_lang string, new_tokenizer string, new_n_tokens long")
    kept.commit("b", token_counts.revisions(changed))
    assert {tuple(r) for r in kept.totals().collect()} == {("s", None, "v1", 1, 0), ("s", "de", "v2", 1, 5)}
    kept.commit("c", token_counts.deletes(changed.selectExpr("new_source source", "new_lang lang", "new_tokenizer tokenizer", "new_n_tokens n_tokens")))
    assert {tuple(r) for r in kept.totals().collect()} == {("s", None, "v1", 1, 0)}


def test_only_committed_batches_count(spark, tmp_path):
    folder = tmp_path / "totals"
    kept = token_counts.TokenTotals(spark, str(folder))
    assert kept.totals().collect() == [] and kept.totals().columns == ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    rows = lambda n: spark.createDataFrame([(None, "en", "v1", n)], "source string, lang string, tokenizer string, n_tokens long")
    assert kept.commit("a", token_counts.inserts(rows(3))) and kept.commit("b", token_counts.inserts(rows(50)))
    assert kept.commit("none", token_counts.inserts(rows(1).where("false")))
    (folder / "batch-b" / "_SUCCESS").unlink()  # as left by a job that failed
    assert not kept.committed("b") and [tuple(r) for r in kept.totals().collect()] == [(None, "en", "v1", 1, 3)]
    assert kept.commit("b", token_counts.inserts(rows(4))) and not kept.commit("b", token_counts.inserts(rows(4)))
    assert [tuple(r) for r in kept.totals().collect()] == [(None, "en", "v1", 2, 7)]
