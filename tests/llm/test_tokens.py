import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayglass.llm import sentencepiece_codec, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", " a", " \n  b  ", "don't we'll 're x'", "!!!<|endoftext|> <|endoftext|><|endo", "x    y", "\x1c\x1d a",
    "日本語\U0001f600", "a" * 300, "=" * 400, " \r\n\t\t x", "é ▁a ▁", "<0x41> <s> <unk>", "\x00 ①",
]


def samples(n=120):
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "'s", "'re", "a", "the", "Z9", "é", "!", "<|endoftext|>", " ", "ñ", "'"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_every_prefix_matches_the_tokenizer(tokenizer):
    counter = token_counts.counter(PATH)
    for text in samples():
        want = [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == want, text
        strings, counts = counter.pieces(text)
        assert sum(counts) == want[-1]
        for limit in (0, 1, 4):
            assert counter.within(text, strings, counts, limit) == max(k for k, c in enumerate(want) if c <= limit)


def test_counts_of_edge_rows(edge, empty, tokenizer):
    rows = token_counts.token_counts(edge, PATH, 20).collect()
    want = []
    for r in edge.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 20))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_stored_prefixes_answer_budgets(spark, tokenizer):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "doc_id bigint, text string")
    stored = token_counts.prefix_counts(docs, PATH)
    got = {r.doc_id: (r.a, r.b) for r in stored.select("doc_id", token_counts.tokens_at(F.col("tokens"), 7).alias("a"), token_counts.longest_within(F.col("tokens"), 3).alias("b")).collect()}
    assert got == {1: (len(tokenizer.encode("the cat").ids), len("the cat sat")), 2: (0, 0)}


def test_codec_matches_the_library():
    own, library = sentencepiece_codec.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in samples():
        want = library.encode(text)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert own.decode(np.array(want, "<u4").tobytes()) == library.decode(want)
        if text:
            marked = sentencepiece_codec.SPACE + text.replace(" ", sentencepiece_codec.SPACE)
            assert list(own.stream(iter(marked))) == want


def test_words_are_searched_once_whatever_follows_them(monkeypatch):
    own, library = sentencepiece_codec.Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    searched = []
    search = own.bpe.encode
    monkeypatch.setattr(own.bpe, "encode", lambda word: searched.append(word) or search(word))
    text = "Zaunkönig Zaunkönig. Zaunkönig, Zaunkönig! Zaunkönig\n Zaunkönig*** Zaunkönig's Zaunkönig\u2019s"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text)
    assert searched.count("▁Zaunkönig") == 1 and sum("Zaunkönig" in w for w in searched) == 2


def test_stream_commits_before_its_end():
    own = sentencepiece_codec.codec(MODEL)
    read = 0

    def characters():
        nonlocal read
        for c in "▁the" * 200:
            read += 1
            yield c

    next(own.stream(characters()))
    assert read <= 2 * own.bpe.longest


def test_codec_of_edge_rows(edge, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepiece_codec.encoding_digest(edge, MODEL).collect()
    want = []
    for r in edge.collect():
        ids = np.array(library.encode(r.text or ""), "<u4")
        want.append((r.doc_id or -1, len(ids), zlib.crc32(ids.tobytes()), True))
    assert sorted((r.doc_id or -1, r.n_ids, r.ids_crc32, r.round_trip) for r in rows) == sorted(want)
    assert sentencepiece_codec.encoding_digest(empty, MODEL).count() == 0
    again = sentencepiece_codec.decode(sentencepiece_codec.encode(edge, MODEL), MODEL)
    assert sorted(r.text for r in again.collect()) == sorted(r.text or "" for r in edge.collect())
