"""Counts and backoff against plain Python; held-out accuracy; odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid as g
from tessera.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, score int"


def test_backoff_by_hand(spark):
    rows = [("aa", "cat Cat dog"), ("bb", "chat chien chat"), (None, "cat"), ("aa", None)]
    model = g.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["aa", "bb"]
    assert set(model.word_table) == {"cat", "chat"}  # at least twice
    assert model.word_table["cat"] == pytest.approx([math.log(2 / 3), math.log(0.5 / 4)])
    counts = defaultdict(Counter)
    for lang, text in rows:
        for w in re.findall("[a-z]+", (text or "").lower()) if lang else []:
            for n in range(1, 6):
                m = f"^{w}$" if n > 1 else w
                counts[lang, n].update(m[i:i + n] for i in range(len(m) - n + 1))

    def brute(word):
        for n in range(min(5, len(word) + 2), 0, -1):
            m = f"^{word}$" if n > 1 else word
            known = [x for x in (m[i:i + n] for i in range(len(m) - n + 1)) if max(counts[lang, n][x] for lang in ("aa", "bb")) >= 2]
            if known:
                return [sum(math.log(counts[lang, n][x] / counts[lang, n].total()) if counts[lang, n][x] else math.log(0.5 / (counts[lang, n].total() + 1)) for x in known) / len(known) for lang in ("aa", "bb")]
        return [0.0, 0.0]

    for w in ["hat", "cats", "chats", "zzz", "o", "chien"]:
        assert list(model.unseen([w])[0]) == pytest.approx(brute(w)), w
    # whole texts: known words by their log frequency, the others by backoff, softmax over sqrt(words)
    texts = ["cat hats", "Chat, zzz! cats", "cat", "dog dog o", None, "cat " * 50]
    langs, scores = model.predict_many(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        ws = re.findall("[a-z]+", (text or "").lower())
        sums = [sum((model.word_table[w] if w in model.word_table else brute(w))[i] for w in ws) for i in range(2)]
        best = sums.index(max(sums))
        want = 1 / sum(math.exp((x - sums[best]) / math.sqrt(len(ws))) for x in sums) if ws else 0.0
        assert lang == (["aa", "bb"][best] if ws else "und") and score == pytest.approx(want)
    assert model.predict("cat")[0] == "aa" and model.predict("CHATS")[0] == "bb" and model.predict("123 _!") == ("und", 0.0)


def test_words_are_letters_and_marks():
    assert g.words("½ ² Ⅷ ①② 12 __ ़") == []
    assert g.words("हिन्दी É́a naïve-e2f") == ["हिन्दी", "é́a", "naïve", "e", "f"]
    model = g.Model(["aa", "bb"], {"x": np.array([-1.0, -2.0])}, {})
    assert [model.predict(t) for t in ("½ ²", "①②", "", None)] == [("und", 0.0)] * 4
    assert model.predict("x ½")[0] == "aa"


def test_remembered_words_do_not_change_scores(monkeypatch):
    monkeypatch.setattr(g, "CACHE", 3)
    table = {x: np.array([-float(i), -2.0]) for i, x in enumerate("abcdefgh")}
    model = g.Model(["aa", "bb"], {"a": np.array([-1.0, -2.0])}, table)
    texts = ["b c d e f", "g h b c", "a b", "h g f e d c b a"]
    first = [g.Model(["aa", "bb"], {"a": np.array([-1.0, -2.0])}, table).predict(t) for t in texts]
    assert [model.predict(t) for t in texts * 3] == first * 3


def test_held_out_accuracy(spark):
    out = g.language_id(read_table(spark, "/root/testdata/sf0.01", "documents"))
    rows = out.join(read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, t, lang, None, "x", 1) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("!? 12", None), ("word " * 200_000, "en"), ("mot mot", "fr"), ("x" * 100_000, "fr"), ("word", None)])]
    df = spark.createDataFrame(rows + rows[3:5] + [(None, "word", "en", None, "x", 1)], SCHEMA)
    out = g.language_id(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 10 and [by[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert g.language_id(df.limit(0)).count() == 0
    empty = g.train(df.limit(0))
    assert {r.lang_pred for r in g.identify(df.select("doc_id", "text"), empty).collect()} == {"und"}
