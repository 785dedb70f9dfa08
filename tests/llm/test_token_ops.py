"""Encoding, counting and token shards against the public libraries; the perfect hash."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stormledger.llm.bpe_codec import ByteBpe, encode_documents
from stormledger.llm.perfect_hash import PerfectHash
from stormledger.llm.storage import locate
from stormledger.llm.token_counts import MergeCounter, count_tokens
from stormledger.llm.token_shards import ShardReader, WordEncoder, read_shards, write_shards

TEXTS = [
    "", " ", "\n \n", "  a\n\n b \t c", "\x1c a \x85b", "it's we'LL 'twas", "<|endoftext|> a<|endoftext|>\n", "aaaaaaaaaaaaaaaaaaaaaaaab" * 3, "日本語 テキスト’s", " lead", "trail ", "a  b", "x　 y z", "word%%% $$$ 12,345.6",
    "Ärger über Ωmega ΣΑΣ ΟΔΟΣ", "é combining", "🙂🙃 emoji", "a" * 3000, "ab" * 2000, "x\ty\x0bz\x0c", "'s 's's", "DON'T <|startoftext|>",
]


def fuzz(n=200, seed=3):
    r = random.Random(seed)
    letters = "aeTs'’ \n\t.,!%é日　 12<|>"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long").repartition(3)


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_encoding_equals_the_library(ranks):
    codec, library = ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS + fuzz():
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert codec.decode(np.array(ids, np.int64)) == t.encode()


def test_encoded_documents(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, None, TEXTS[3]]
    got = {r.doc_id: r for r in encode_documents(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, t or "", len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_null_keys_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    assert encode_documents(empty, *path).collect() == []
    assert count_tokens(empty, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string")
    assert encode_documents(nulls, *path).count() == count_tokens(nulls, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 4


def test_counts_equal_the_library(spark):
    library, counter = Tokenizer.from_file(P.path("byte_bpe_50k.json")), MergeCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    texts = TEXTS + fuzz(seed=4)
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = count_tokens(frame(spark, ["a" * 30_000, "é", None]), P.path("byte_bpe_50k.json"), P.PATTERN, limit=1).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.over_limit) for r in got] == [(30_000, True), (2, False), (0, False)]


def shards_by_hand(rows):
    library, start, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_shards_round_trip(spark, tmp_path):
    texts = [t for t in TEXTS + fuzz(40, seed=5)]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(4, "again # ##"), (4, "again"), (99_999, None)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start long").repartition(4)
    manifest = write_shards(df, P.path("word_bpe_49k.json"), f"file://{tmp_path}/s", 2)
    assert sorted(map(tuple, read_shards(manifest).collect()), key=str) == shards_by_hand(rows)
    reader = ShardReader(manifest.first().shard)
    there, _, _ = reader.find(np.array([10**12 + i for i in range(50)]))
    assert there.sum() <= 1
    assert read_shards(write_shards(df.where("false"), P.path("word_bpe_49k.json"), f"file://{tmp_path}/e", 2)).collect() == []


def test_words_of_letters_are_encoded_together(monkeypatch):
    """Many words to a call, with the ids that the library gives of each; also where a word gives two pre-tokens or a letter's case adds a mark."""
    r = random.Random(31)
    words = ["".join(r.choices("abcdeéñßσςΣжКüÉo", k=r.randrange(1, 14))) for _ in range(3000)] + ["İstanbul", "ǰo", "ﬁn", "数据", "한국", "e\u0301te", "ªº", "it's", "a1b", "x\u0345y", "<|endoftext|>"]
    library, given = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    encoder = WordEncoder(P.path("word_bpe_49k.json"), 2, "<u2")

    class Counted:
        def encode_batch_fast(self, batch, **how):
            given.append(len(batch))
            return library.encode_batch_fast(batch, **how)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    encoder.learn(set(words[:3000]))
    assert sum(given) <= 20
    encoder.learn(set(words))
    assert {w: np.frombuffer(encoder.memo[w], "<u2").tolist() for w in words} == {w: library.encode(w, add_special_tokens=False).ids for w in words}


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    ph = PerfectHash(keys)
    assert ph.lookup(keys).tolist() == list(range(5000))
    assert (ph.lookup([f"x{i}".encode() for i in range(500)]) == -1).all()
    assert PerfectHash([]).lookup([b"a"]).tolist() == [-1] and PerfectHash([b""]).lookup([b"", b"b"]).tolist() == [0, -1]


def test_locations():
    assert locate("file:///tmp/x")[1] == "/tmp/x" == locate("/tmp/x")[1]
