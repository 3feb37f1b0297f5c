"""Alignment of two tokenizers' tokens by the bytes they end at, composed from fragments of byte ranges.

The tokens of tokenizer A (byte-level BPE) and B (pieces with byte fallback) of one text are cut into groups at every
byte where a token of both ends. A fragment describes a byte range of a text: an open prefix (tokens up to the first
common end; their group may have begun before the range), closed groups, and an open suffix (tokens after the last
common end). Two neighbouring fragments compose to one: suffix and prefix meet and are closed by the prefix's end. A
range without a common end is all open. Composition is associative, so the fragments of a long text are made in any
tasks and folded in a tree, `FAN` neighbours a level; a text of one range is a tree of one leaf and moves nowhere.

Ranges are CHUNK characters long. A task encodes its range from the last safe border before it to the first one after
it and keeps the tokens that end inside. Safe is the place before a single space between two other characters: in
both vocabularies a space can only begin a token there, so encoding the parts gives the tokens of the whole. A range
border with no safe place since the range before is left out, so each character is encoded twice at most, and a
stretch without spaces stays whole in one task, as the merges of one word need it.

Links are pairs of an A and a B token that end together; they lie within a fragment. How many links an id pair has in
the corpus is summed per fragment, per task, then by a shuffle on the pair; fragments meet the counts in a join on the
pair, one row per distinct pair of a fragment, and no text is sent there.

A text that is null or empty, or whose A or B tokens do not join to the bytes of space + text, has no tokens: zeros, and
empty groups. Rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm import bpe
from casewatch.llm import words as W

CHUNK = 1 << 16
FAN = 8
PAIR_BITS = 20  # of a B id in a pair; ids of both must be smaller
ROWS = 250
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_OPEN = ("prefix_a", "prefix_b", "closed", "suffix_a", "suffix_b")
_FRAGMENT = (
    "row_id long, doc_id long, chunk int, n_chunks int, ok boolean, n_a long, n_b long, n_groups long, "
    "prefix_a string, prefix_b string, closed string, suffix_a string, suffix_b string, pairs array<struct<pair:long,n:long>>"
)
_FOLDED = "row_id long, doc_id long, chunk int, n_chunks int, ok boolean, n_a long, n_b long, n_groups long, prefix_a string, prefix_b string, closed string, suffix_a string, suffix_b string"


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of each token and each id's text in front of the three separators."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encode_a = bpe.plain_encoder(byte_path, special=False)
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.encode_b = lambda text: pieces.encode(text, num_threads=1)
        known = bpe.vocabulary(byte_path).bytes_of
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))
        ]
        self.size_a, self.size_b = (np.array([*map(len, x)], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        if self.width > 1 << PAIR_BITS:
            raise ValueError(f"vocabularies of more than {1 << PAIR_BITS} tokens")
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.width)]

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by A and B; None if they do not give its bytes back."""
        spaced = f" {text}"
        a, b = self.encode_a(spaced), self.encode_b(text)
        want = spaced.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
        return (a, b) if same else None


_loaded: dict = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


@dataclass
class Fragment:
    """Ids as text, joined by commas. `closed` is None where no common end lies in the range: then all is prefix."""

    prefix_a: str = ""
    prefix_b: str = ""
    closed: str | None = None
    suffix_a: str = ""
    suffix_b: str = ""

    def then(self, right: Fragment) -> Fragment:
        """The fragment of both ranges, this one first."""
        if self.closed is None:
            return Fragment(_comma(self.prefix_a, right.prefix_a), _comma(self.prefix_b, right.prefix_b), right.closed, right.suffix_a, right.suffix_b)
        across = (_comma(self.suffix_a, right.prefix_a), _comma(self.suffix_b, right.prefix_b))
        if right.closed is None:
            return Fragment(self.prefix_a, self.prefix_b, self.closed, *across)
        closed = ";".join(x for x in (self.closed, "|".join(across), right.closed) if x)
        return Fragment(self.prefix_a, self.prefix_b, closed, right.suffix_a, right.suffix_b)


def _comma(one: str, two: str) -> str:
    return f"{one},{two}" if one and two else one or two


def ranges(text: str, size: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """(encode from, encode to, keep from, keep to) in characters of space + text; the first starts at 0."""
    spaced, total = f" {text}", len(text) + 1
    borders = [(0, 0, 0)]  # safe place before, border, safe place after
    for at in range(size, total, size):
        after = _SAFE.search(spaced, at)
        after_at = after.start() if after else total
        before, window = -1, 64
        while before < borders[-1][1]:
            low = max(at - window, borders[-1][1])
            # the look-behind sees the character before `low`
            for before_match in _SAFE.finditer(spaced, low, min(at + 2, total)):
                before = before_match.start() if before_match.start() <= at else before
            if low == borders[-1][1]:
                break
            window *= 8
        if before >= borders[-1][1] and before > 0:
            borders.append((before, at, after_at))
    borders.append((total, total, total))
    return [(a[0], b[2], a[1], b[1]) for a, b in zip(borders, borders[1:])]


def _group_text(tok: Tokenizers, a: np.ndarray, b: np.ndarray, close_a: np.ndarray, close_b: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2` of tokens whose last ones of each group are marked; the last group is closed."""
    group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
    shown = np.empty(len(a) + len(b), dtype=np.int64)
    shown[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + np.where(close_a, tok.width, 0)
    shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + np.where(close_b, 2 * tok.width, 0)
    return "".join(map(tok.shown.__getitem__, shown.tolist()))[:-1]


def _ids(x: np.ndarray) -> str:
    return ",".join(map(str, x.tolist()))


def fragment(tok: Tokenizers, text: str, low: int, high: int) -> tuple[Fragment, int, int, np.ndarray, np.ndarray] | None:
    """The fragment of the bytes low to high of space + text, its numbers of A and B tokens, and the ids of its links.

    None if the tokens of `text` do not give its bytes back.
    """
    found = tok.tokens(text) if text else None
    if found is None:
        return None
    a, b = (np.array(x, dtype=np.int64) for x in found)
    end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
    if low > 0 or high < end_a[-1]:
        in_a, in_b = (slice(np.searchsorted(e, low, side="right"), np.searchsorted(e, high, side="right")) for e in (end_a, end_b))
        a, end_a, b, end_b = a[in_a], end_a[in_a], b[in_b], end_b[in_b]
    _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    if not len(at_a):
        return Fragment(_ids(a), _ids(b)), len(a), len(b), a[at_a], b[at_b]
    close_a, close_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    close_a[at_a] = close_b[at_b] = True
    first_a, first_b, last_a, last_b = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
    closed = _group_text(tok, a[first_a:last_a], b[first_b:last_b], close_a[first_a:last_a], close_b[first_b:last_b]) if len(at_a) > 1 else ""
    parts = Fragment(_ids(a[:first_a]), _ids(b[:first_b]), closed, _ids(a[last_a:]), _ids(b[last_b:]))
    return parts, len(a), len(b), a[at_a], b[at_b]


def _fragments(byte_path: str, piece_path: str):
    """Task that turns (row_id, doc_id, chunk, n_chunks, low, high, text) into fragments; texts begin after a space."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_path, piece_path)
        for batch in batches:
            lows, highs = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for from_, to, texts in bpe.texts_of(batch.column(6)):
                numbers, opened, keys, ends = [], [], [], [0]
                for text, low, high in zip(texts, lows[from_:to], highs[from_:to]):
                    made = fragment(tok, text, low, high)
                    if made is None:
                        numbers.append((False, 0, 0, 0))
                        opened.append(Fragment())
                        ends.append(ends[-1])
                        continue
                    parts, n_a, n_b, a, b = made
                    pairs, n = np.unique(a << PAIR_BITS | b, return_counts=True)
                    numbers.append((True, n_a, n_b, len(a)))
                    opened.append(parts)
                    keys.append((pairs, n))
                    ends.append(ends[-1] + len(pairs))
                pair, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*keys) if keys else ((), ())))
                linked = pa.StructArray.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])
                ok, n_a, n_b, n_groups = zip(*numbers)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[from_:to] for i in range(4)), pa.array(ok), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                     *(pa.array([getattr(f, name) for f in opened], pa.string()) for name in _OPEN), W.lists(np.array(ends), linked)],
                    ["row_id", "doc_id", "chunk", "n_chunks", "ok", "n_a", "n_b", "n_groups", *_OPEN, "pairs"],
                )

    return run


def _cut(size: int):
    """Task that cuts long texts into rows of the shape that `_fragments` takes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                spaced, parts = f" {text}", ranges(text, size)
                for chunk, (from_, to, low, high) in enumerate(parts):
                    before = len(spaced[from_:low].encode())
                    row = (row_id, doc_id, chunk, len(parts), before, before + len(spaced[low:high].encode()), spaced[from_ + 1 : to])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                        ["row_id", "doc_id", "chunk", "n_chunks", "low", "high", "text"],
                    )

    return run


def fragments(docs: DataFrame, byte_path: str, piece_path: str, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text, or per byte range of a text of more than `size` characters. `row_id` tells rows apart.

    The long texts alone are cut and dealt to all tasks. Store the result before reading it twice.
    """
    W.small_batches(docs.sparkSession, ROWS)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long_ = F.coalesce(F.length("text") > size, F.lit(False))
    one = lambda value, kind: F.lit(value).cast(kind)
    short = rows.where(~long_).select("row_id", "doc_id", one(0, "int").alias("chunk"), one(1, "int").alias("n_chunks"), one(0, "long").alias("low"), one(1 << 62, "long").alias("high"), "text")
    cut = rows.where(long_).mapInArrow(_cut(size), "row_id long, doc_id long, chunk int, n_chunks int, low long, high long, text string")
    task = _fragments(byte_path, piece_path)
    return short.mapInArrow(task, _FRAGMENT).unionByName(cut.repartition("row_id", "chunk").mapInArrow(task, _FRAGMENT))


def _fold(batches) -> Iterator[pa.RecordBatch]:
    """Compose neighbouring fragments with equal row_id and chunk; rows come in order of their place in the text."""

    def done():
        values = [*head, *numbers, *(getattr(parts, n) for n in _OPEN)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 3, *[pa.string()] * 5]
        names = ["row_id", "doc_id", "chunk", "n_chunks", "ok", "n_a", "n_b", "n_groups", *_OPEN]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    head, numbers, parts = None, [], Fragment()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            new, right = row[:4], Fragment(*row[8:13])
            if head is not None and (head[0], head[2]) == (new[0], new[2]):
                numbers = [numbers[0] and row[4], *(x + y for x, y in zip(numbers[1:], row[5:8]))]
                parts = parts.then(right)
                continue
            if head is not None:
                yield done()
            head, numbers, parts = new, list(row[4:8]), right
    if head is not None:
        yield done()


def composed(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Whole texts from fragments: levels of `fan` neighbours each, folded in order, until one is left per text."""
    columns = [c.strip().split(" ")[0] for c in _FOLDED.split(",")]
    parts = parts.select(*columns)
    width = parts.agg(F.max("n_chunks")).first()[0] or 1
    while width > 1:
        level = parts.withColumn("place", F.col("chunk")).withColumn("chunk", F.floor(F.col("chunk") / fan).cast("int"))
        ordered = level.repartition("row_id", "chunk").sortWithinPartitions("row_id", "chunk", "place")
        parts = ordered.select(*columns).mapInArrow(_fold, _FOLDED)
        width = -(-width // fan)
    return parts


def whole_groups() -> Column:
    """The group text of a whole text's fragment; empty if it has no tokens."""
    first = F.concat_ws("|", "prefix_a", "prefix_b")
    return F.when(~F.col("ok"), F.lit("")).when(F.col("closed") != "", F.concat_ws(";", first, "closed")).otherwise(first)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best) of links (pair, n): `best` if no pair of the same B id has a higher count."""
    counts = W.stored(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1))
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, byte_path: str, piece_path: str, keep: dict[str, Column] | None = None, size: int = CHUNK, fan: int = FAN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    `keep` names what stays of `groups` as expressions over that column, so that texts larger than their document
    need not be written where a digest will do.
    """
    keep = {"groups": F.col("groups")} if keep is None else keep
    made = fragments(docs, byte_path, piece_path, size, id_col, text_col)
    single = F.col("n_chunks") == 1
    slim = [F.when(single, F.lit(None)).otherwise(F.col(c)).alias(c) for c in _OPEN]
    kept = lambda df: [e.alias(name) for name, e in keep.items()]
    base = ["row_id", "doc_id", "chunk", "n_chunks", "ok", "n_a", "n_b", "n_groups"]
    digested = made.withColumn("groups", F.when(single, whole_groups()).otherwise(F.lit("")))
    table = W.stored(digested.select(*base, "pairs", *slim, *kept(digested)), "fragments")

    long_rows = composed(table.where(~single), fan).withColumn("groups", whole_groups())
    long_rows = W.stored(long_rows.select(*base, *kept(long_rows)), "long-texts")
    bad = long_rows.where(~F.col("ok")).select("row_id")
    links = table.where(F.col("ok")).select("row_id", "n_chunks", F.explode("pairs").alias("link")).select("row_id", "n_chunks", "link.pair", "link.n")
    links = links.where(single).select("row_id", "pair", "n").unionByName(
        links.where(~single).join(bad, "row_id", "left_anti").select("row_id", "pair", "n")
    )
    rated = W.stored(pair_counts(links), "pairs")
    sums = links.join(rated.hint("shuffle_hash"), "pair").groupBy("row_id").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
    rows = table.where(single).select(*base, *keep).unionByName(long_rows)
    counted = [F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")]
    summed = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "row_id", "left").select("doc_id", *counted, *summed, *keep)
