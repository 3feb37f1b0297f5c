"""Token alignment against whole-text brute force, for any chunk size and any order of composition."""

import functools
import random
from collections import Counter, defaultdict

import pytest

from casewatch.llm import alignment, queries

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "<s> </s> <|endoftext|> <unk> <0x41>"), (6, "café 中文。 \U0001f600 naïve"),
    (7, "low ▁ block"), (8, "\n\t\r\n tabs\x00nul"), (None, "no id at all"), (9, "same words here"), (9, "same words here"), (10, "same words here"),
    (11, "longword" * 400), (12, " ".join(f"word{i}, and" for i in range(900))), (13, "中" * 700), (14, "x ▁ " + "bad later " * 300), (15, " " * 1500 + "x"),
    (16, "good words come first " * 200 + "▁"),
]
SCHEMA = "doc_id long, text string, row_id long, chunk string, groups string, pairs int"


@pytest.fixture(scope="module")
def paths():
    return queries.vocabulary_path(), queries.vocabulary_path(queries.PIECES)


@pytest.fixture(scope="module")
def tok(paths):
    return alignment.Tokenizers(*paths)


@functools.cache
def brute_tokens():
    """A function that gives [(id, end)] of both tokenizers by their own libraries, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(queries.vocabulary_path())
    byte.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECES))
    from casewatch.llm.bpe import byte_letters

    letters = byte_letters()

    def tokens(text):
        if not text:
            return None
        want = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return None
        ended = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((i, at))
            ended.append(out)
        return ended

    return tokens


def brute(rows):
    """The contract's columns, groups in place of their digest."""
    tokens = [brute_tokens()(t) for _, t in rows]
    links, counts = [], Counter()
    for found in tokens:
        own = []
        if found:
            ends = {e: i for i, e in found[0]}
            own = [(ends[e], i) for i, e in found[1] if e in ends]
        links.append(own)
        counts.update(own)
    most = defaultdict(int)
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), found, own in zip(rows, tokens, links):
        groups = []
        if found:
            common = sorted({e for _, e in found[0]} & {e for _, e in found[1]})
            for low, high in zip([0, *common], common):
                groups.append("|".join(",".join(str(i) for i, e in side if low < e <= high) for side in found))
        out.append((
            doc_id, len(found[0]) if found else 0, len(found[1]) if found else 0, len(groups), len(own),
            sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), ";".join(groups),
        ))
    return Counter(out)


@pytest.mark.parametrize("size,fan", [(1 << 16, 8), (40, 2), (300, 3)])
def test_alignment_equals_brute_force(spark, paths, size, fan):
    docs = spark.createDataFrame([(i, t, 0, "clash", "clash", 0) for i, t in ODD], SCHEMA).repartition(3)
    got = alignment.align(docs, *paths, size=size, fan=fan)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.collect()) == brute(ODD)
    assert alignment.align(docs.where("false"), *paths, size=size).collect() == []


def test_real_documents(spark, sf_dir, paths):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.align(docs, *paths, size=2000).collect()) == brute(rows)


def test_fragments_compose_in_any_order(tok):
    rng = random.Random(4)
    for _, text in ODD:
        whole = alignment.fragment(tok, text, 0, 1 << 62) if text else None
        if whole is None:
            continue
        size = len(text.encode()) + 1
        for _ in range(6):
            cuts = sorted({0, size, *(rng.randint(0, size) for _ in range(rng.randint(0, 12)))})
            made = [alignment.fragment(tok, text, a, b) for a, b in zip(cuts, cuts[1:])]
            parts = [x[0] for x in made]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i].then(parts[i + 1])]
            assert parts[0] == whole[0]
            assert sum(x[1] for x in made) == whole[1] and sum(len(x[3]) for x in made) == whole[3].size
            assert parts[0].then(alignment.Fragment()) == parts[0] == alignment.Fragment().then(parts[0])


def test_ranges_encode_no_character_more_than_twice():
    texts = ["word " * 500, "a" * 3000, "", "a b", "x" * 990 + " y" + "z" * 990 + " end", ("a" * 400 + " ") * 20, "one  two  three  four " * 60]
    for text in texts:
        spaced = f" {text}"
        for size in (10, 100, 997):
            parts = alignment.ranges(text, size)
            assert [p[2] for p in parts] == [0, *(p[3] for p in parts[:-1])] and parts[-1][3] == len(spaced)
            seen = [0] * len(spaced)
            for from_, to, low, high in parts:
                assert from_ <= low < high <= to and (from_ == 0 or alignment._SAFE.match(spaced, from_)) and (to == len(spaced) or alignment._SAFE.match(spaced, to))
                for i in range(from_, to):
                    seen[i] += 1
            assert max(seen) <= 2 and min(seen) >= 1


def test_long_white_space_is_encoded(paths):
    from casewatch.llm import bpe
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(paths[0])
    for text in ("\n" * 300_000 + "x", " " * 300_000, "a\t" * 10 + "\t" * 100_000 + "b", "a" * 300_000, "　" * 5000 + "<|endoftext|>"):
        assert bpe.plain_encoder(paths[0])(text) == byte.encode(text, add_special_tokens=False).ids
