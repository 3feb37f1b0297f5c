"""Byte-pair encoding and decoding by a prefix-sharing walk over the distinct words of a task.

Method: the distinct words of a batch, in sorted order, are the depth-first traversal of their trie. Each trie
node keeps one state, the last token of the encoding of its prefix; the encoding of a word is read back from
the states along its path, so a prefix shared by many words is encoded once. The last token of a prefix is the
one token that ends it and can follow the last token of the prefix before it; whether two tokens may stand
side by side is decided from the merges along their touching edges (`Vocabulary.fits`), without merging text.

Words come from the tokenizer's own split pattern; special tokens are cut out first. Each Python worker keeps a
bounded map of encoded words over its tasks, so memory does not grow with the input. No shuffle takes place.

Nulls count as empty text and give no ids; rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W

# Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62
TAIL = 4
KEPT_WORDS = 600_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Token ids, merge ranks and token edges of a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        text_ids = {token: i for token, i in content["model"]["vocab"].items() if token not in special}
        raw = {token: bytes(letters[c] for c in token) for token in text_ids}
        self.ids = {raw[token]: i for token, i in text_ids.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.ranks: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (text_ids[left], text_ids[right])
            self.ranks[pair] = rank
            made.setdefault(text_ids[left + right], (*pair, rank))
        # Edges: the tokens that stand at a token's left or right border while it is merged, each with the
        # rank at which the next one replaces it.
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for token in sorted(self.ids.values(), key=lambda i: len(self.bytes_of[i])):
            if token in made:
                a, b, rank = made[token]
                self.left[token] = [*self.left[a][:-1], (self.left[a][-1][0], rank), (token, NEVER)]
                self.right[token] = [*self.right[b][:-1], (self.right[b][-1][0], rank), (token, NEVER)]
            else:
                self.left[token] = self.right[token] = [(token, NEVER)]
        # Lengths, longest first, of the tokens that are longer than their last TAIL bytes, by these bytes.
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > TAIL:
                lengths.setdefault(token[-TAIL:], set()).add(len(token))
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        self.tails: dict[bytes, list[tuple[int, int | None]]] = {}
        self.memo: dict[int, bool] = {}

    def fits(self, before: int, after: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is just these two tokens.

        Both are merged step by step in order of rank; they fit if no merge across the border comes up before
        the border token of either side is replaced (at equal rank the leftmost merge goes first).
        """
        ranks, one, two = self.ranks, self.right[before], self.left[after]
        i = j = 0
        while True:
            a, a_until = one[i]
            b, b_until = two[j]
            across = ranks.get((a, b), NEVER)
            if across < a_until and across <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode_distinct(self, distinct: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) for each word, by one depth-first pass over the trie of all words."""
        get, memo, fits, tails = self.ids.get, self.memo, self.fits, self.tails
        last: list[int] = []  # last token of each prefix on the current path
        from_: list[int] = []  # where that token starts
        previous = b""
        for word in sorted(distinct):
            shared, size = 0, len(word)
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared:], from_[shared:]
            for end in range(shared + 1, size + 1):
                tail = word[end - TAIL if end > TAIL else 0 : end]
                ending = tails.get(tail)
                if ending is None:
                    ending = self._ending(tail)
                for length, token in ending:
                    start = end - length
                    if start < 0:
                        continue
                    if token is None:
                        token = get(word[start:end])
                        if token is None:
                            continue
                    if start:
                        pair = last[start - 1] << 20 | token
                        fit = memo.get(pair)
                        if fit is None:
                            if len(memo) > KEPT_WORDS:
                                memo.clear()
                            fit = memo[pair] = fits(last[start - 1], token)
                        if not fit:
                            continue
                    last.append(token)
                    from_.append(start)
                    break
            previous = word
            out, at = [], size
            while at:
                out.append(last[at - 1])
                at = from_[at - 1]
            out.reverse()
            yield word, out

    def _ending(self, tail: bytes) -> list[tuple[int, int | None]]:
        """(length, token) of the tokens that can end a prefix with this tail, longest first.

        The token is None where it is longer than the tail and must be looked up. Kept for later words.
        """
        if len(self.tails) > KEPT_WORDS:
            self.tails.clear()
        longer = [(n, None) for n in self.lengths.get(tail, ())]
        within = [(len(tail) - k, self.ids[tail[k:]]) for k in range(len(tail)) if tail[k:] in self.ids]
        self.tails[tail] = longer + within
        return self.tails[tail]

    def pieces(self, text: str, pattern=regex.compile(PATTERN)) -> list[str]:
        """The words of a text in order; special tokens are words of their own."""
        if self.cut is None or not self.cut.search(text):
            return pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else pattern.findall(part)
        return out


_loaded: dict = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def kept_coder(path: str, value: Callable, join: Callable) -> Coder:
    """The worker's coder of this kind; a new worker starts with an empty one, so results never depend on it."""
    key = (path, value.__name__)
    if key not in _loaded:
        _loaded[key] = Coder(path, value, join)
    return _loaded[key]


class Coder:
    """Encoded parts of texts, kept from task to task of a Python worker.

    A part is what stands between single spaces or line ends, with its space or line end; the split pattern never
    joins across such a border unless two white spaces meet there, and texts with those are split as a whole.
    `value(ids, vocabulary)` says what is kept of a word, `join(values)` of several. Parts are kept by a key: the
    part without its space, or after a NUL where it has none; words by the key of the part that they alone would
    be, those with a NUL or with white space at an end after two NULs. At `KEPT_WORDS` keys the map becomes the older one, from which keys move back
    when they are met again; the older one before it is dropped.
    """

    def __init__(self, path: str, value: Callable, join: Callable):
        self.vocabulary, self.value, self.join = vocabulary(path), value, join
        self.kept: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def texts(self, texts: list[str]) -> list[list]:
        """The values of each text's parts in order; new words of all texts are encoded together."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        cut = [self._cut(t) for t in texts]
        parts = {p: self._words(p) for p in self._new(set().union(*(c for c in cut if c is not None)))}
        self._encode({k for keys in parts.values() if keys for k in keys})
        for p, keys in parts.items():
            if keys != [p]:
                self.kept[p] = self.join([*map(self.kept.__getitem__, keys)]) if keys else None
        values = [c and [*map(self.kept.__getitem__, c)] for c in cut]
        whole = {
            i: [*map(_key, self.vocabulary.pieces(texts[i]))] for i, found in enumerate(values) if found is None or None in found
        }
        self._encode(set().union(*whole.values()))
        for i, keys in whole.items():
            values[i] = [*map(self.kept.__getitem__, keys)]
        return values

    def _new(self, keys: set[str]) -> set[str]:
        """The keys without a value; those of the older map move back."""
        new = keys.difference(self.kept)
        for k in [k for k in new if k in self.older]:
            self.kept[k] = self.older[k]
            new.discard(k)
        return new

    def _encode(self, keys: set[str]) -> None:
        """Give each word a value."""
        words = {_word(k): k for k in self._new(keys)}
        for s in words.keys() & self.vocabulary.special.keys():
            self.kept[words.pop(s)] = self.value([self.vocabulary.special[s]], self.vocabulary)
        for word, ids in self.vocabulary.encode_distinct([w.encode() for w in words]):
            self.kept[words[word.decode()]] = self.value(ids, self.vocabulary)

    def _cut(self, text: str) -> list[str] | None:
        """Keys of the parts of a text; None where it must be split as a whole."""
        if not text:
            return []
        if "\0" in text or any(s in text for s in self.vocabulary.special):
            return None
        return f"\0{text}".replace("\n", " \n").split(" ")

    def _words(self, part: str) -> list[str]:
        """Keys of the words of a part; none where another white space touches it."""
        plain = _PLAIN(part)
        if plain:
            return [plain[1], f"\0{plain[2]}"] if plain[2] else [part]
        if _touched(part[1:] if part[:1] in ("\n", "\0") else part):
            return []
        return [*map(_key, self.vocabulary.pieces(_word(part)))]


# Latin letters, then marks: two words at most whatever follows.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?%]*)").fullmatch


def _key(word: str) -> str:
    spaced = word[0] == " "
    if "\0" in word or _touched(word[1:] if spaced else word):
        return f"\0\0{word}"
    return word[1:] if spaced else f"\0{word}"


def _touched(bare: str) -> bool:
    """Whether white space begins or ends a part, or it is nothing."""
    return not bare or bare[0].isspace() or bare[-1].isspace()


def _word(key: str) -> str:
    return key[2:] if key[:2] == "\0\0" else key[1:] if key[0] == "\0" else key if key[0] == "\n" else f" {key}"


def id_bytes(ids: list[int], _: Vocabulary) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def id_text(ids: list[int], v: Vocabulary) -> tuple[str, bytes]:
    return ",".join(map(str, ids)), b"".join(map(v.bytes_of.__getitem__, ids))


def join_texts(values: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return ",".join([v[0] for v in values]), b"".join([v[1] for v in values])


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for low, high, data, offsets in W.slices(column):
        raw = data.tobytes()
        yield low, high, [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text."""
    W.small_batches(docs.sparkSession)

    def run(batches):
        coder = kept_coder(vocabulary_path, id_bytes, b"".join)
        for batch in batches:
            for low, high, texts in texts_of(batch.column(1)):
                packed = [b"".join(x) for x in coder.texts(texts)]
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
                values = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], W.lists(offsets, values)], ["doc_id", "ids"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD. Null ids give null text."""

    def run(batches):
        bytes_of = vocabulary(vocabulary_path).bytes_of
        for batch in batches:
            texts = [
                None if ids is None else b"".join(bytes_of[i] for i in ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    W.small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode the ids, digest both."""
    W.small_batches(docs.sparkSession)

    def run(batches):
        coder = kept_coder(vocabulary_path, id_text, join_texts)
        for batch in batches:
            for low, high, texts in texts_of(batch.column(1)):
                n, ids, decoded = [], [], []
                for values in coder.texts(texts):
                    listed, back = join_texts(values)
                    n.append(listed.count(",") + 1 if listed else 0)
                    ids.append(hashlib.sha256(listed.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
                columns = [batch.column(0)[low:high], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_pieces(
    docs: DataFrame, vocabulary_path: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each document's ids and the end id, cut at `most` ids.

    A longer document is cut so that all pieces but the first have `most` ids. `ids` holds unsigned 32-bit
    little-endian numbers, as a training loader reads them.
    """
    W.small_batches(docs.sparkSession)

    def run(batches):
        encoder = plain_encoder(vocabulary_path)
        for batch in batches:
            for low, high, texts in texts_of(batch.column(1)):
                rows, piece, start, length, held = [], [], [], [], []
                for row, text in enumerate(texts, low):
                    ids = np.array([*encoder(text), end_id], dtype="<u4")
                    cuts = [0, *range(len(ids) - (len(ids) - 1) // most * most, len(ids) + 1, most)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        held.append(ids[a:b].tobytes())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# The compiled pattern below runs out of stack on long white space; such texts go to the tokenizers library.
_LONG_SPACE = re.compile(r"\s{200}")


def plain_encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    """Ids of a text, for operators whose own method is not the encoding.

    Both libraries used here give the same ids; the faster one cannot take long runs of white space. Strings of
    special tokens are ordinary text unless `special`.
    """
    if (path, "plain", special) not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        v = vocabulary(path)
        fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
        slow = Tokenizer.from_file(path)
        slow.no_truncation()
        slow.no_padding()
        slow.encode_special_tokens = not special

        def encode(text: str) -> list[int]:
            if _LONG_SPACE.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text)

        _loaded[path, "plain", special] = encode
    return _loaded[path, "plain", special]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
