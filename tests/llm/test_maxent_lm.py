"""Counts and base scores against plain Python; a proper distribution; gain on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import maxent_lm as m
from tessera.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, words string, rid int"


def brute_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)), b""]


def check_base(rows, got):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in brute_tokens(t))
    total, kinds = counts.total(), len(counts)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        toks, r = brute_tokens(t), by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks), sum(counts[w] > 0 for w in toks), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in toks), rel=1e-9)


def test_tokens():
    for t in [None, "", " ", "A bÀ\tc\n", "x\x00y z", "a b\x0bc\x1c d", "é" * 9]:
        assert m.tokens(t) == brute_tokens(t)


def test_real_rows(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = m.lm_scores(docs).collect()
    assert len(got) == len(rows)
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, "", "  ", "one two", "One TWO three", "long " * 100_000, "x" * 50_000, "a\x00b"] * 4)]
    df = spark.createDataFrame([(i, t, "en", "w", 1) for i, t in rows], SCHEMA)
    got = m.lm_scores(df).collect()
    assert len(got) == len(rows)
    check_base(rows, got)
    assert all(r.score <= 0 for r in got)
    assert m.lm_scores(df.limit(0)).count() == 0
    only = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    none = m.lm_scores(df.filter(df.doc_id.isin(only))).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in none} == {(0, 0, 0.0)} and all(math.isfinite(r.score) for r in none)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, f"the cat {'sat' if i % 3 else 'ran'} on w{i % 40} the mat.", "en", "w", 1) for i in range(200)], SCHEMA)
    counts = m.count_tokens(df.select("text"))
    v = m.build_vocabulary(counts)
    w = m.train(df.select("text"), v)
    table = {bytes(r.word): r.n for r in counts.collect()}
    histories = [(b"", b""), (b"the", b""), (b"cat", b"the"), (b"w7", b"on")]
    for last, before in histories:
        total = 0.0
        ctx = lambda x: m.START if not x else int(v.context[v.words[x]]) if x in v.words else m.RARE_BASE + m.BINS + m.rare_class(x)
        f = m.features(np.array([ctx(last)]), np.array([ctx(before)]))
        for word, n in table.items():
            i = v.words.get(word, -1)
            cls = np.array([v.cls[i] if i >= 0 else m.BINS + m.rare_class(word)])
            place = np.array([v.place[i] if i >= 0 else -1])
            p = math.exp(w.run(cls, place, f)[0])
            total += p * ((n + 1) / v.denominator[cls[0] - m.BINS] if place[0] < 0 else 1)
        # what is missing is the share of unseen words of the rare classes
        unseen = sum(math.exp(w.run(np.array([m.BINS + k]), np.array([-1]), f)[0]) / v.denominator[k] for k in range(m.RARE))
        empty = sum(math.exp(w.run(np.array([k]), np.array([0]), f)[0]) for k in range(m.BINS) if v.sizes[k] == 0)
        assert total + unseen + empty == pytest.approx(1, abs=1e-5)
