"""Kept parts of a worker against the tokenizer itself, on texts that stress the part borders."""

import random

from tokenizers import Tokenizer

from casewatch.llm import bpe, queries

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "½", "\0", "<|endoftext|>", ".", ",", "%", "\x1c", "\x85", "\r\n", "1", "Hello", " of", "ª", "×"]


def test_parts_match_the_tokenizer(monkeypatch):
    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    chance = random.Random(5)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 200)  # the kept parts are renewed many times
    coder = bpe.Coder(path, bpe.id_text, bpe.join_texts)
    for _ in range(80):
        texts = ["".join(chance.choices(PIECES, k=chance.randint(0, 14))) for _ in range(50)]
        for text, values in zip(texts, coder.texts(texts)):
            ids = library.encode(text, add_special_tokens=False).ids
            listed, raw = bpe.join_texts(values)
            assert listed == ",".join(map(str, ids))
            assert raw.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
