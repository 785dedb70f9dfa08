"""Quality rules, filter audit and spelling variants against brute force and SQL; edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stormledger.llm import byte_scan, filter_audit, queries, repetition, spelling
from stormledger.llm.repetition import quality_rules
from stormledger.llm.spelling import spelling_variants

from ..compare import assert_same, connect
from ..conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_texts(r):
    """Few different words, white space of all kinds, wide characters, symbols, repeated lines, long words, long texts."""
    pool = ["a", "bb", "É", "ccc", "D#", "wide　space", "x" * 70, "y" * 70, "😀", "nb sp", "TOP", "low", "$|%"]
    out = ["", " ", "\n\n", "one", "one\n", "\none\none", None]
    for _ in range(60):
        n = r.randrange(1, 160)
        out.append("".join(r.choice(pool[: r.choice([3, 13])]) + r.choice([" ", " ", "\t", "\n", "\r\n", "\x0b", "  ", "\x1c"]) for _ in range(n)))
    line = " ".join(r.choice(pool) for _ in range(9))
    out += ["\n".join([line] * 30), "\n".join(f"{line} {i % 7}" for i in range(30)), " ".join(f"w{i}" for i in range(400_000)), out[12], out[12]]
    return out


def frame(spark, rows):
    """Rows of (doc_id, text, lang) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, k, 1, "x", "y", 2) for i, t, k in rows], "doc_id long, text string, lang string, mask int, part string, word string, n int").repartition(3)


def by_hand(t):
    w = WORD.findall(t or "")
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or ""))}
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for x in (t or "").split("\n"):
        if own := WORD.findall(x):
            out["n_dup_lines"] += x in seen
            out["dup_line_chars"] += (x in seen) * sum(map(len, own))
            seen.add(x)
    for n in (3, *repetition.NGRAM_LIMITS):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        counts = Counter(grams)
        inside = {k for i, g in enumerate(grams) if counts[g] > 1 for k in range(i, i + n)}
        out["n_repeat_words" if n == 3 else f"dup_{n}gram_chars"] = len(inside) if n == 3 else sum(len(w[k]) for k in inside)
    return out


def test_repetition_like_brute_force():
    texts = odd_texts(random.Random(1))
    got = repetition.measure(pa.array(["cut off", *texts, "too"]).slice(1, len(texts)))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == by_hand(t), repr(t)[:200]
    none = repetition.measure(pa.array([], pa.string()))
    assert set(none) == set(repetition.MEASURES) and all(len(v) == 0 for v in none.values())
    assert all((v == 0).all() for v in repetition.measure(pa.array([None, ""], pa.string())).values())


def test_quality_rules(spark):
    r = random.Random(2)
    plain = " ".join(f"p{r.randrange(10**6)}" for _ in range(200))
    passage = " ".join(f"passage{i}" for i in range(20))
    often = plain + (" " + passage) * 6  # 120 of 320 words: the base rule keeps it, the method doesn't
    rows = [(1, plain, "en"), (1, plain, "en"), (None, often, None), (2, (passage + " ") * 30, "en"), (3, None, "en"), (4, plain + "\n" + passage + "\n" + passage, "fr")]
    got = sorted((str(x.doc_id), x.n_words, x.base_failed, x.kept) for x in quality_rules(frame(spark, rows)).collect())
    assert got == sorted([("1", 200, False, True), ("1", 200, False, True), ("None", 320, False, False), ("2", 600, True, False), ("3", 0, True, False), ("4", 240, False, True)])
    assert quality_rules(frame(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("name", ["op11_repetition", "op12_filter_audit"])
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF).sql(queries.ORACLES[name]))


def test_distinct_words_verified(monkeypatch):
    texts = odd_texts(random.Random(3))
    want = [len(set(WORD.findall(t or ""))) for t in texts]
    data, bounds = byte_scan.buffers(pa.array(texts))
    found = byte_scan.words(data, bounds)
    assert filter_audit.distinct_words(data, *found, len(texts)).tolist() == want
    same = lambda data, starts, ends: np.full(len(starts), 7, np.uint64)  # noqa: E731  all hashes collide
    monkeypatch.setattr(filter_audit, "hashes", same)
    assert filter_audit.distinct_words(data, *found, len(texts)).tolist() == want


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in {o for o, *_ in filter_audit.steps()}:
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                fails = [d for d in docs if d[0] == part and f in d[1]]
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, k + 1] = [len(left), len(removed), len(fails) - len(removed), sum(d[1] == {f} for d in fails), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_like_brute_force(spark):
    r = random.Random(4)
    rows = [(i, t, r.choice(["en", "fr", None, ""])) for i, t in enumerate(odd_texts(r))]
    rows += [(i, rows[9][1], "en") for i in (1000, 1000, 5, None, None)] + [(5, "", "fr"), (None, "", "de")]
    labels = [(r.randrange(80), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(60)] + [(None, 1, 1)]
    frame_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.audit_filters(frame(spark, rows), frame_).collect()}
    assert got == audit_by_hand(rows, labels)
    assert filter_audit.audit_filters(frame(spark, rows).where("false"), frame_).collect() == []


def spelling_by_hand(rows):
    n = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    cut = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            cut[w[:p] + w[p + 1 :]].add((w, p))
    near = defaultdict(set)
    for short, found in cut.items():
        for w, p in found:
            near[w] |= {v for v, q in found if p == q and v != w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def spelled(df):
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in df.collect()}


def test_spelling_like_brute_force(spark):
    r = random.Random(5)
    letters = "abcdeé×à"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 14))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    texts = []
    for k, w in enumerate(base):
        texts.append(" ".join([w] * 3000 if k % 4 == 0 else [w.capitalize()] * 40))
        for _ in range(25):
            v, p = w, r.randrange(len(w))
            for _ in range(r.choice([1, 1, 2])):
                v = r.choice([v[:p] + v[p + 1 :], v[:p] + r.choice(letters) + v[p:], v[:p] + r.choice(letters) + v[p + 1 :]])
                p = r.randrange(len(v))
            texts.append(" ".join([v] * r.choice([1, 2, 30, 250])))
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[1]), (3, texts[1]), (90_000, None), (90_001, ""), (90_002, "z" * 4_000 + " " + "z" * 4_000)]
    want = spelling_by_hand(rows)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] and v[1] != v[0] for v in want.values())
    got = spelled(spelling_variants(frame(spark, [(i, t, "en") for i, t in rows])))
    assert got == want
    assert spelling_variants(frame(spark, [(1, "some text here", "en")]).where("false")).collect() == []


def test_spelling_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert spelled(queries.QUERIES["op13_spelling"](spark, SF)) == spelling_by_hand([(x.doc_id, x.text) for x in docs.collect()])


def test_bands_agree_in_two():
    """Every single edit leaves two bands equal under one key, whatever the letters."""
    r = random.Random(6)
    for _ in range(400):
        w = "".join(r.choice("aabcéñ") for _ in range(r.randrange(7, 15)))
        p = r.randrange(len(w))
        for v in (w[:p] + w[p + 1 :], w[:p] + r.choice("bxÿ") + w[p + 1 :]):
            keys = [{tuple(int(k[c][i]) for c in ("kind", "length", "x", "y")) for i in range(6) if bool(k["longer"][i]) is up} for k, up in ((spelling.band_keys([v]), False), (spelling.band_keys([w]), len(v) < len(w)))]
            assert keys[0] & keys[1]
