"""Rows with repeated or null ids, recall against brute force, very long texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stormledger.llm import decontaminate as dec
from stormledger.llm import near_copies
from stormledger.llm.components import connected_components
from stormledger.llm.near_copies import sketches, text_links, without_near_copies
from stormledger.llm.secrets import redact, scan_secrets
from stormledger.llm.substring_dedup import repeated_passages
from stormledger.llm.token_counts import MergeCounter
from stormledger.llm.toxicity import threat_forms

from ..conftest import SF
from .test_text_ops import prose, spans_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, spans int"


def table(spark, pairs):
    return spark.createDataFrame([(k, t, "en", f"s{i % 4}", None if t is None else len(t), 7, "x", 1) for i, (k, t) in enumerate(pairs)], SCHEMA).repartition(3)


def by_row(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


def test_near_copies_keep_unique_texts(spark):
    docs = table(spark, [(3, "some text"), (5, "some text"), (5, "another one"), (None, "some text"), (3, "some text"), (8, None), (9, " "), (None, "no id at all")])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert by_row(out) == sorted([(3, "some text"), (5, "another one"), (8, None), (None, "no id at all")], key=str)
    assert without_near_copies(docs.where("false")).collect() == []


@pytest.mark.parametrize("chunk", [near_copies.CHUNK_TEXTS, 2])
def test_near_copies_like_brute_force(spark, monkeypatch, chunk):
    r = random.Random(21)
    texts = []
    for _ in range(40):
        base = prose(r, r.randrange(30, 160), 9000).split()
        texts.append(base)
        for edits in (1, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "row long, text string")
    monkeypatch.setattr(near_copies, "CHUNK_TEXTS", chunk)
    links = [(x.u, x.v) for x in text_links(sketches(rows), rows).collect()]
    of = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if like(i, j) >= 0.8]
    assert len(near) > 40 and sum(of.get(i, i) == of.get(j, -1 - j) for i, j in near) >= 0.98 * len(near)
    exact = connected_components(spark.createDataFrame(near, "u long, v long"))
    exact = {x.node: x.component for x in exact.collect()}
    assert all(exact[u] == exact[v] for u, v in links)  # no link but those of the brute-force groups


def test_secrets_go_by_row(spark):
    docs = table(spark, [(1, "completely harmless prose here, nothing secret"), (1, "x password=hunter2hunter2 y"), (None, "password=nullkey12345"), (1, "x password=hunter2hunter2 y"), (4, None), (5, "token=abcdefgh " * 2000)])
    got = sorted((str(x.doc_id), x.n_assign, x.spans) for x in scan_secrets(docs).collect())
    long = ",".join(spans_by_hand("token=abcdefgh " * 2000))
    assert got == sorted([("1", 0, ""), ("1", 1, "assign:2:25"), ("None", 1, "assign:0:21"), ("1", 1, "assign:2:25"), ("4", 0, ""), ("5", 2000, long)])
    out = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert out.columns == docs.columns and redact(docs.where("false")).collect() == []
    want = [(1, "completely harmless prose here, nothing secret"), (1, "x password=[SECRET] y"), (None, "password=[SECRET]"), (1, "x password=[SECRET] y"), (4, None), (5, "token=[SECRET] " * 2000)]
    assert by_row(out) == sorted(want, key=str)
    assert {x.n_chars for x in out.where("doc_id is null").collect()} == {17}


def test_contaminated_rows_go_whatever_their_id(spark, tmp_path):
    r = random.Random(22)
    items = [prose(r, 30, 3000) + "." for _ in range(15)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = [prose(r, 80, 3000) for _ in range(6)]
    docs = table(spark, [(1, clean[0]), (1, clean[1] + " " + items[3]), (None, items[5] + " " + clean[2]), (None, clean[3]), (1, clean[1] + " " + items[3]), (2, None), (3, "")])
    out = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}")
    assert by_row(out) == sorted([(1, clean[0]), (None, clean[3]), (2, None), (3, "")], key=str) and out.columns == docs.columns


def brute_force(texts, items):
    """(text, item) with a stretch of the text of 1.25 item lengths that has 0.85 of the item's words in order."""
    found = set()
    for j, item in enumerate(items):
        a = np.array([hash(w) for w in item])
        for i, t in enumerate(texts):
            b = np.array([hash(w) for w in t])
            n = int(1.25 * len(a))
            if any(dec.lcs_length(a, b[k : k + n]) >= 0.85 * len(a) for k in range(0, max(1, len(b) - len(a) // 2), 4)):
                found.add((i, j))
    return found


def test_latent_search_like_brute_force(spark):
    r = random.Random(23)
    items = [prose(r, r.randrange(20, 55), 2500).split() for _ in range(24)]
    texts = []
    for i in range(90):
        w = prose(r, r.randrange(60, 260), 2500).split()
        if i % 2:
            own = [x for x in items[i % 24] if r.random() > 0.08]
            at = r.randrange(len(w))
            w[at:at] = own
        texts.append(w)
    want = brute_force(texts, items)
    docs = table(spark, enumerate(map(" ".join, texts)))
    benchmark = spark.createDataFrame(list(enumerate(map(" ".join, items))), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dec.contaminated(docs, benchmark).collect()}
    assert len(want) >= 40 and len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.1 * len(got)


def test_truncated_svd(spark):
    """Singular values and directions against numpy's; other directions give other candidates."""
    r = random.Random(24)
    items = [prose(r, 30, 300) for _ in range(12)]
    texts = [prose(r, 200, 300) + " " + items[i % 12] for i in range(60)]
    (block,) = dec.read_items(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    hits = dec.benchmark_words(table(spark, enumerate(texts)), block.vocabulary).cache()
    counts, n = dec.block_counts(hits, len(block.vocabulary))
    idf = np.log((2 + n) / (1 + counts))
    rows = []
    for t in texts:
        at = [block.vocabulary.get(w, -1) for w in t.split()]
        for a in range(0, len(at), 2 * dec.STEP):
            x = np.zeros(len(idf))
            for b in (a, a + dec.STEP):
                own = np.unique([k for k in at[b : b + dec.STEP] if k >= 0]).astype(int)
                x[own] += idf[own]
            rows.append(x)
    u, s, v = np.linalg.svd(np.array(rows), full_matrices=False)
    directions, sigma = dec.randomised_svd(hits, idf, rank=8, oversample=40)
    assert sigma.shape == (8,) and np.allclose(sigma, s[:8], rtol=0.05)  # a flat spectrum, one power iteration
    assert abs(directions[:, 0] @ v[0]) > 0.99
    (batch,) = hits.limit(30).toArrow().combine_chunks().to_batches()
    blocks = dec.Blocks.of(batch)[0]
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(idf), 8)))
    one, two = (dec.Searcher(block, dec.LatentSpace.of(block, idf, idf, d, sigma), 0.5).candidates(blocks) for d in (directions, q))
    assert set(zip(one[0].tolist(), one[1].tolist(), strict=True)) != set(zip(two[0].tolist(), two[1].tolist(), strict=True))


def test_long_runs_of_letters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, theirs = MergeCounter(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    r = random.Random(25)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "eéx"):
        for n in (1023, 1024, 5000):
            text = "".join(r.choice(letters) for _ in range(n))
            assert counter.count([text + " end"]) == [len(theirs.encode(text + " end", add_special_tokens=False).ids)]


def test_threats_are_inflected():
    assert {"killed", "stabbing", "tuerai", "tötet", "mataré", "destruyó"} <= threat_forms()


def test_repeated_passages_count_words_between_spaces(spark):
    text = "  " + " ".join(f"q{i}" for i in range(48))
    longer = " " + " ".join(f"p{i}" for i in range(60)) + "\u2003"
    got = {x.doc_id: x.spans for x in repeated_passages(table(spark, [(1, text), (2, text), (3, longer), (4, longer)])).collect()}
    assert got == {1: "", 2: "", 3: "0-60", 4: "0-60"}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, tmp_path, stage):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"file://{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert stage(spark, docs, f"file://{tmp_path}").collect() == []
    assert stage(spark, docs, SF).collect() == []  # nothing is left of the documents alone


def test_stages_on_clean_documents(spark):
    """No text shares a word with the benchmark; columns have names that stages use, and none is n_chars."""
    rows = [(k, t, "en", "s", "x", "y", "z") for k, t in ((1, "qwx zzy vvk"), (2, None), (None, ""), (3, "kkq " * 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __key string, key string, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        kept = [1, 3, None] if name == "simhash" else [1, 2, 3, None]
        assert out.columns == docs.columns and len(out.collect()) == len(kept), name
