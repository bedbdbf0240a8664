"""BPE and token counts against the public libraries, on texts of every kind."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from collections import Counter
from pathlib import Path

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import bpe, pretokens, queries, token_counts
from scriptorium.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "it's we'll DON'T", "  two  spaces \n\n\t x ", "Ünïcödé straße 日本語 👍🏽 \x1c\x85  ½²Ⅷ", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "a" * 5000, "ab" * 4000, "12345 678", "\r\n" * 50, "؀́é", "q" * 63 + " " + "é" * 40, "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(VOCABULARY)


def test_pattern_is_the_public_one():
    assert public_tokenizers.PATTERN == pretokens.BYTE_LEVEL


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_split_of_any_text(text):
    assert pretokens.splitter(pretokens.BYTE_LEVEL)(text) == regex.findall(pretokens.BYTE_LEVEL, text)


def test_split_of_every_common_character():
    for c in range(0x260):
        text = f"a{chr(c)}1 {chr(c)}a {chr(c)}{chr(c)} {chr(c)} 1{chr(c)}!'s"
        assert pretokens.splitter(pretokens.BYTE_LEVEL)(text) == regex.findall(pretokens.BYTE_LEVEL, text), c


def test_pieces(library):
    r = random.Random(3)
    pieces = [bytes(r.choices(b"abcthein rsd\xc3\xa9\x00!", k=r.randrange(1, 150))) for _ in range(600)]
    pieces += [bytes([b]) for b in range(256)] + [b"a" * 3000, b" " * 70, b"=" * 64, b"=" * 65]
    merges = bpe.merges_of_ranks(Path(RANKS).read_bytes())
    for piece, ids in zip(pieces, merges.encode(pieces)):
        assert list(memoryview(ids).cast("I")) == library._encode_single_piece(piece)
        assert merges.decode(ids) == piece


def docs_of(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "null id", "y", 1), (1, "", "z", 2)], "doc_id long, text string, ids string, n_tokens int")


def test_encoding(spark, library):
    rows = bpe.encoded(docs_of(spark), RANKS, round_trip=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows[: len(TEXTS)]:
        text = TEXTS[row["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and row["n_tokens"] == len(ids)
        assert bytes(row["decoded"]) == text.encode()


def test_counts(spark, counter):
    rows = token_counts.counted(docs_of(spark), VOCABULARY).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows[: len(TEXTS)]:
        text = TEXTS[row["doc_id"]] or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(counter.encode(text, add_special_tokens=False).ids)), text[:20]
        assert row["over_limit"] == (row["n_tokens"] > 512)


def test_frequent_pretokens_are_the_most_frequent(spark, counter):
    """Measured on all of a small table; the table's lengths are the library's, whatever their size."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    words, share = token_counts.frequent_pretokens(docs, sample_rows=10**6, entries=500)
    counts = Counter(p for r in docs.select("text").collect() for p in regex.findall(pretokens.BYTE_LEVEL, r["text"] or ""))
    least = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:500]
    assert words == [w for w, _ in least] and abs(share - sum(n for _, n in least) / counts.total()) < 1e-12
    long = "=" * 3 + "x" * 2000 + "é" * 900
    merges = bpe.merges_of_json(Path(VOCABULARY).read_bytes())
    lengths = token_counts._Lengths(token_counts.lengths_table([*words, long], merges))
    for word in [*words[::50], long]:
        assert lengths[word] == len(merges.encode([word.encode()])[0]) // 4
    assert lengths[long] > 255


def test_a_sample_changes_no_count(spark, smallest):
    docs = table(spark, smallest, "documents")
    whole, part = (sorted(map(tuple, token_counts.counted(docs, VOCABULARY, sample_rows=n).collect())) for n in (10**6, 3))
    assert whole == part


def test_caches_that_overflow_change_nothing():
    merges = bpe.merges_of_ranks(Path(RANKS).read_bytes())
    cache, lengths = bpe.PieceCache(limit=2000), token_counts._Lengths(token_counts.lengths_table(["a", "b"], merges), limit=2000)
    for step in range(40):
        pieces = {f" word{step}", f" word{step // 3}", "the", "x" * 50 * step}
        cache.fill(merges, pieces)
        lengths.fill(merges, pieces)
        for p in pieces:
            assert cache[p] == merges.encode([p.encode()])[0]
            assert lengths[p] == len(cache[p]) // 4
        assert cache.bytes <= 2000 + 30_000 and lengths.bytes <= 2000 + 30_000 and lengths["a"] == 1
    assert len(cache) < 40 and len(lengths) < 40


def test_invalid_utf8_and_odd_columns(spark, library, counter):
    df = spark.sql("select 1L as doc_id, cast(x'6120ff62' as string) as text, 'k' as `a.b`, 'z' as of_text")
    row = bpe.encoded(df, RANKS, keep=("doc_id", "a.b", "of_text"), round_trip=True).first()
    assert (row["a.b"], row["of_text"]) == ("k", "z")
    assert bytes(row["decoded"]).decode() == "a \ufffdb" and row["n_tokens"] == len(library.encode_ordinary("a \ufffdb"))
    assert token_counts.counted(df, VOCABULARY).first()["n_tokens"] == len(counter.encode("a \ufffdb").ids)


def test_queries(spark, smallest, library, counter):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, smallest, "documents").collect()}
    for row in queries.op2_byte_bpe(spark, smallest).collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    for row in queries.op5_token_counts(spark, smallest).collect():
        assert row["n_tokens"] == len(counter.encode(texts[row["doc_id"]], add_special_tokens=False).ids)


def test_empty_tables(spark):
    assert bpe.encoded(docs_of(spark).limit(0), RANKS).collect() == []
    assert token_counts.counted(docs_of(spark).limit(0), VOCABULARY).collect() == []
