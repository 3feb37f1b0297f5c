"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map.

Tokens are the words of a text with A-Z in lower case, then one end token; the first word follows a begin mark.

1. Tasks count their (context, token) pairs and send them in shards by the pair's hash: sorted 64-bit words,
   delta-coded and packed. A shard is merged in one go; shards are cut by hash, so no word or pair makes one large.
2. A merged shard writes its pair hashes and counts as arrays to the shared folder and passes on what its words
   need: token and continuation counts, and followers seen once, twice and more often. These are summed per word
   in a second round of shards, which write the word arrays.
3. Each task maps the arrays and looks up the distinct pairs of its texts in sorted order.

Discounts come from the counts of counts of all pairs and of all continuation counts. The lowest order is mixed
with a uniform share for the unknown word, so every text has a finite score. The driver gets one small row of
sums per shard.

Null and empty texts are the end token alone. Rows with a null id are scored, not learned from. Repeated rows are
learned and scored each. With nothing to learn from, every token has probability 1.
"""

from __future__ import annotations

import io
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import session
from casewatch.llm import words as W

END, BEGIN = 1, 2  # all other values are whole 64-bit hashes of words; of n words n * n / 2**65 pairs are equal
_FEW = 255


def pack_planes(values: np.ndarray) -> bytes:
    """Byte planes of integers, compressed; high planes of small numbers cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(context + W.mix(token, 21))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, document) of every token of the documents, end tokens included."""
    words = W.split(data, offsets, lower=True)
    n = np.diff(words.first) + 1
    total = int(n.sum())
    ends = np.cumsum(n) - 1
    token = np.empty(total, dtype=np.uint64)
    is_word = np.ones(total, dtype=bool)
    is_word[ends] = False
    token[is_word] = np.maximum(words.hashes, np.uint64(BEGIN + 1))
    token[ends] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - n + 1] = BEGIN
    return context, token, np.repeat(np.arange(len(n)), n)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of each array of values."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _shards(owner: np.ndarray, shards: int) -> np.ndarray:
    return ((owner >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Written under a name of its own, then moved into place: a repeated task leaves the same file."""
    files, path = W.file_system(f"{folder}/{name}.npy")
    part = f"{path}.{uuid.uuid4().hex}"
    buffer = io.BytesIO()
    np.save(buffer, values)
    with files.open_output_stream(part) as out:
        out.write(buffer.getbuffer())
    files.move(part, path)


def _load(folder: str, name: str) -> np.ndarray:
    """Mapped from a mounted folder; from another kind of store, read."""
    from pyarrow import fs

    files, path = W.file_system(f"{folder}/{name}.npy")
    if isinstance(files, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with files.open_input_file(path) as file:
        return np.load(io.BytesIO(file.read()))


@dataclass
class Model:
    folder: str
    shards: int
    tokens: int
    vocabulary: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    continuations: int
    low_share: float  # of the uniform distribution in the lowest order


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts 1 to 4; zero where a count is missing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [k - (k + 1) * y * b / a if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), k - 0.0) for k, d in enumerate(out, 1))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


def count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, contexts, tokens, counts): a task's distinct pairs of a shard, sorted by context."""

    def run(batches):
        held, size = [], 0

        def flush():
            context, token = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((token, context))
            context, token = context[order], token[order]
            fresh = np.concatenate([[True], (context[1:] != context[:-1]) | (token[1:] != token[:-1])])
            first = np.flatnonzero(fresh)
            count = np.diff([*first, len(context)]).astype(np.uint64)
            context, token = context[first], token[first]
            shard = _shards(pair_keys(context, token), shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            columns = ([], [], [], [])
            for s in range(shards):
                at = order[cuts[s] : cuts[s + 1]]
                if len(at):
                    for values, v in zip(columns, (s, pack_planes(np.diff(context[at], prepend=np.uint64(0))), pack_planes(token[at]), pack_planes(count[at]))):
                        values.append(v)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "contexts", "tokens", "counts"])

        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column(0)):
                context, token, _ = tokens(data, offsets)
                held.append((context, token))
                size += len(token)
                if size > 6_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "shard int, contexts binary, tokens binary, counts binary")


def _shards_of(batches, width: int):
    """(shard, its rows' columns) of batches sorted by shard."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width))):
            if row[0] != current:
                if held:
                    yield current, held
                current, held = row[0], []
            held.append(row[1:])
    if held:
        yield current, held


def merge_pairs(parts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes the pair arrays; (kind 0, shard, sums) and (kind 1, word shard, words, packed stats)."""

    def run(batches):
        for shard, rows in _shards_of(batches, 4):
            context = np.concatenate([np.cumsum(unpack_planes(r[0])) for r in rows])
            token, count = (np.concatenate([unpack_planes(r[i]) for r in rows]) for i in (1, 2))
            order = np.lexsort((token, context))
            context, token, count = context[order], token[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (token[1:] != token[:-1])]))
            count = np.add.reduceat(count, first).astype(np.int64)
            context, token = context[first], token[first]
            keys = pair_keys(context, token)
            order = np.argsort(keys)
            many = count[order] >= _FEW
            _save(folder, f"pair-keys-{shard}", keys[order])
            _save(folder, f"pair-counts-{shard}", np.minimum(count[order], _FEW).astype(np.uint8))
            _save(folder, f"pair-many-{shard}", np.stack([keys[order][many].view(np.int64), count[order][many]]))
            zero = np.zeros_like(count)
            word, *stats = _sums(
                np.concatenate([context, token]), np.concatenate([zero, count]), np.concatenate([zero, zero + 1]),
                *(np.concatenate([(count == k) if k < 3 else count >= 3, zero]).astype(np.int64) for k in (1, 2, 3)),
            )
            owner = _shards(W.mix(word, 31), shards)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(shards + 1))
            kind, place, packed = [0], [shard], [np.bincount(np.minimum(count, 5), minlength=6)[1:5].astype(np.int64).tobytes()]
            words: list[bytes] = [b""]
            for s in range(shards):
                at = order[cuts[s] : cuts[s + 1]]
                if len(at):
                    kind.append(1)
                    place.append(s)
                    words.append(pack_planes(np.diff(word[at], prepend=np.uint64(0))))
                    packed.append(pack_planes(np.concatenate([x[at] for x in stats])))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(words, pa.binary()), pa.array(packed, pa.binary())], ["kind", "shard", "words", "stats"])

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "kind int, shard int, words binary, stats binary")


def merge_words(parts: DataFrame, folder: str) -> DataFrame:
    """Writes the word arrays; (shard, vocabulary, tokens, continuations, n1..n4 and 3-or-more of continuations)."""

    def run(batches):
        for shard, rows in _shards_of(batches, 3):
            word = np.concatenate([np.cumsum(unpack_planes(r[0])) for r in rows])
            stats = np.concatenate([unpack_planes(r[1]).astype(np.int64).reshape(5, -1) for r in rows], axis=1)
            word, count, continued, *followers = _sums(word, *stats)
            _save(folder, f"word-keys-{shard}", word)
            _save(folder, f"word-stats-{shard}", np.stack([count, continued, *followers], axis=1))
            # the begin mark is a context, not a token
            seen = np.bincount(np.minimum(continued, 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[int((count > 0).sum()), int(count.sum()), int(continued.sum()), *map(int, seen[1:5]), int((continued >= 3).sum())]], pa.list_(pa.int64()))], ["shard", "sums"])

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, sums array<long>")


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count and store the model of all texts given."""
    spark = docs.sparkSession
    W.small_batches(spark)
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = session.scratch_path(spark, "language-model")
    files, path = W.file_system(folder)
    files.create_dir(path)
    parts = count_pairs(docs.select(F.col(text_col).cast("string")), shards)
    merged = W.stored(merge_pairs(parts, folder, shards), "word-parts")
    pairs = np.zeros(4, dtype=np.int64)
    for row in merged.where("kind = 0").select("stats").toLocalIterator():  # one small row per shard
        pairs += np.frombuffer(row[0], dtype=np.int64)
    words = np.zeros(8, dtype=np.int64)
    for row in merge_words(merged.where("kind = 1").select("shard", "words", "stats"), folder).toLocalIterator():
        words += np.array(row[1], dtype=np.int64)
    vocabulary, total, continuations, n1, n2, n3, n4, more = map(int, words)
    low = _discounts([n1, n2, n3, n4])
    share = (low[0] * n1 + low[1] * n2 + low[2] * more) / continuations if continuations else 1.0
    return Model(folder, shards, total, vocabulary, _discounts([int(x) for x in pairs]), low, continuations, share)


class Lookup:
    """The arrays of a model in a worker."""

    def __init__(self, model: Model):
        self.model = model
        files, path = W.file_system(model.folder)
        from pyarrow import fs

        there = {f.base_name for f in files.get_file_info(fs.FileSelector(path))}
        self.pairs, self.words = {}, {}
        for s in range(model.shards):
            if f"pair-keys-{s}.npy" in there:
                self.pairs[s] = [_load(model.folder, f"pair-{n}-{s}") for n in ("keys", "counts", "many")]
            if f"word-keys-{s}.npy" in there:
                self.words[s] = [_load(model.folder, f"word-{n}-{s}") for n in ("keys", "stats")]

    def _find(self, keys: np.ndarray, owner: np.ndarray, arrays: dict, out: np.ndarray, read) -> np.ndarray:
        """Fill `out` for the sorted keys that a shard holds."""
        shard = _shards(owner, self.model.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s, held in arrays.items():
            at = order[cuts[s] : cuts[s + 1]]
            place = np.minimum(np.searchsorted(held[0], keys[at]), len(held[0]) - 1)
            hit = held[0][place] == keys[at]
            out[at[hit]] = read(held, place[hit], keys[at[hit]])
        return out

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        return self._find(words, W.mix(words, 31), self.words, np.zeros((len(words), 5), dtype=np.int64), lambda held, at, _: held[1][at])

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        def read(held, at, wanted):
            count = held[1][at].astype(np.int64)
            many = count == _FEW
            if many.any():
                count[many] = held[2][1][np.searchsorted(held[2][0].view(np.uint64), wanted[many])]
            return count

        return self._find(keys, keys, self.pairs, np.zeros(len(keys), dtype=np.int64), read)

    def logs(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of the model, log10 of the base, known) of each token."""
        m = self.model
        words, at = np.unique(np.concatenate([context, token]), return_inverse=True)
        stats = self.word_stats(words)
        v, w = at[: len(context)], at[len(context) :]
        low = _discounted(stats[:, 1], m.low_discounts) / max(m.continuations, 1) + m.low_share / (m.vocabulary + 1)
        base = np.log10((stats[:, 0] + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        keys = pair_keys(context, token)
        distinct, place = np.unique(keys, return_inverse=True)
        count = self.pair_counts(distinct)[place]
        # a context's total: the pairs that start with it, i.e. its own count, or the texts begun
        total = np.where(words == BEGIN, stats[words == END][:, 0].sum() if (words == END).any() else 0, stats[:, 0])
        total = total[v]
        left = (stats[:, 2:] * np.array(m.discounts)).sum(axis=1)[v]
        lower = low[w]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (_discounted(count, m.discounts) + left * lower) / total, lower)
        return np.log10(p), base[w], stats[w, 0] > 0


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns with n_tokens, n_known, train_tokens, base_score and score of every row."""
    W.small_batches(docs.sparkSession, 4000)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    width, names = len(keep), [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        lookup = Lookup(model)
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(width), 8 << 20):
                context, token, doc = tokens(data, offsets)
                full, base, known = lookup.logs(context, token)
                n = high - low
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i)[low:high] for i in range(width)), pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc[known], minlength=n)), pa.array(np.full(n, model.tokens)),
                    pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, full, n)),
                ], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:width])
    return source.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
