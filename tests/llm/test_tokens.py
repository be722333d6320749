"""Token files, byte-level BPE and fingerprints."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshtide.llm import bpe, fingerprints, token_files
from meshtide.llm.queries import QUERIES

from .conftest import rows_of, same_rows

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = P.path("byte_bpe_50k.json")
LETTERS = "ab c\n\t  　 éßñ'sdtl09.,!$|\x1c\x1d\x85​\r\x0b漢字😀\x00"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_of_awkward_rows(docs, awkward, reference):
    expected = []
    for d, t in awkward:
        ids = reference.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same_rows(bpe.round_trip(docs, RANKS, P.PATTERN), expected)
    assert {r.ids for r in bpe.encode(docs, RANKS, P.PATTERN).collect()} == {bytes(little(reference.encode_ordinary(t or ""))) for _, t in awkward}


def test_decode_gives_the_texts_back(docs, awkward, no_docs):
    ids = bpe.encode(docs, RANKS, P.PATTERN)
    found = bpe.decode(ids.withColumn("text", F.lit("not read")), RANKS, P.PATTERN)
    same_rows(found.select("doc_id", F.col("decoded").cast("string")), [(d, t or "") for d, t in awkward])
    assert {(r.doc_id, r.ids) for r in found.collect()} == {(r.doc_id, r.ids) for r in ids.collect()}
    assert [bytes(r.decoded) for r in bpe.decode(ids.limit(1).withColumn("ids", F.lit(None).cast("binary")), RANKS, P.PATTERN).collect()] == [b""]
    assert bpe.decode(bpe.encode(no_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect() == []


def test_bpe_of_random_texts(reference):
    codec, r = bpe.Codec(RANKS, P.PATTERN), random.Random(4)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "the" * 700, "é" * 3000, "=-" * 1500 + "the" * 2000, ""]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text[:60])
        assert codec.decode(ids) == text.encode()


def test_encoder_of_random_texts(library):
    encoder, r = token_files.Encoder(VOCABULARY), random.Random(4)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(3000)] + ["one two, three.\nfour <|endoftext|> five.."]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_of_awkward_rows(docs, awkward, library):
    at, expected = 0, []
    for d, t in sorted(awkward, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), zlib.crc32(little(ids))))
        at += len(ids)
    same_rows(token_files.digests(docs, VOCABULARY), expected)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    r = random.Random(bits)
    ids = np.array([r.randrange(1 << bits) for _ in range(3007)], np.uint32)
    held = token_files.TokenFile(token_files.pack_file([5, None, 9], [1000, 0, 2007], ids, bits, 3, 4, block=512))
    assert (held.ids(0, 3007) == ids).all() and (held.ids(777, 2333) == ids[777:2333]).all() and (held.document(2) == ids[1000:]).all()
    assert [(d, s, len(x)) for d, s, x in held.documents()] == [(5, 0, 1000), (None, 1000, 0), (9, 1000, 2007)]


def test_width_is_least():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_fingerprints_of_awkward_rows(docs, awkward):
    found = rows_of(fingerprints.compare_to_next(docs.where("doc_id is not null")))
    assert found == sorted(fingerprints.brute_force([r for r in awkward if r[0] is not None]), key=str)
    assert len(fingerprints.compare_to_next(docs).collect()) == len(awkward)


def test_fingerprint_of_one_row_and_of_blocks(spark, monkeypatch):
    text = "some text that is long enough to fill a few buckets, " * 50
    (row,) = fingerprints.compare_to_next(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert row.near_next == 1.0 and row.n_chars == len(text)
    whole = fingerprints.bucket_counts(text.encode())
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert (fingerprints.bucket_counts(text.encode()) == whole).all()


def test_likeness_is_bounded_and_symmetric():
    r = random.Random(9)
    prints = [fingerprints.fingerprint(bytes(r.randrange(256) for _ in range(n))) for n in (0, 1, 4, 5, 50, 5000)]
    for a in prints:
        for b in prints:
            assert 0 <= fingerprints.likeness(a, b) == fingerprints.likeness(b, a) <= 1
            assert (fingerprints.likeness(a, b) == 1) == (a == b)


@pytest.mark.parametrize("name", ["op3_token_files", "op4_fingerprints", "op6_byte_bpe"])
def test_empty_table(name, no_docs):
    made = {"op3_token_files": lambda: token_files.digests(no_docs, VOCABULARY), "op4_fingerprints": lambda: fingerprints.compare_to_next(no_docs),
            "op6_byte_bpe": lambda: bpe.round_trip(no_docs, RANKS, P.PATTERN)}
    assert name in QUERIES and made[name]().collect() == []


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two, three\nfour.", "word<|endoftext|>,", "<|endoftext|><|endoftext|> x", "<|endoftext"])
def test_added_tokens_as_the_library_takes_them(library, text):
    own = token_files.Encoder(VOCABULARY)
    assert own.encode([text, "plain words, too", text]) == [little(library.encode(t, add_special_tokens=False).ids) for t in (text, "plain words, too", text)]
