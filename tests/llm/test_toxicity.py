"""Features against plain Python; held-out quality; odd rows."""

import numpy as np

from tessera.llm import toxicity as t
from tessera.sources.tables import read_table

DOCS = "doc_id long, text string, lang string, toxic int, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(text):
    raw = (" " + text.lower() + " ").encode() if text else b""
    out = set()
    for n in t.ORDERS:
        for i in range(len(raw) - n + 1):
            h = raw[i]
            for c in raw[i + 1:i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            out.add(((h ^ n) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - t.BIN_BITS)
    return out


def test_bins(monkeypatch):
    bins = t.Bins()
    for text in ["", None, "a", "Abc défg " * 9, "x" * 40]:
        assert set(bins(text).tolist()) == brute(text)
    monkeypatch.setattr(t, "CHUNK", 7)
    assert set(bins("Abc défg hij klm " * 5).tolist()) == brute("Abc défg hij klm " * 5)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    rows = t.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 800
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit >= 0.8 * (rows.toxic == 1).sum() and hit >= 0.85 * rows.predicted.sum()
    assert rows.score.between(0, 1).all() and np.array_equal(rows.predicted, (rows.score >= 0.3).astype(int))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, x, "en", 1, "s") for i, x in enumerate([None, "", "bad awful", "nice day", "bad", "fine", "z" * 200_000] * 6)] + [(None, "bad", "en", 0, "s")], DOCS)
    labels = spark.createDataFrame([(i, None, int(i % 7 in (2, 4)), "y") for i in range(42)] + [(None, 1, 1, "y"), (3, 1, None, "y"), (2, 0, 0, "y")], LABELS)
    out = t.toxicity(docs, labels).collect()
    assert len(out) == 43
    by = {r.doc_id: r for r in out}
    assert by[0].score == by[1].score and by[2].score > by[3].score and 0 <= by[6].score <= 1
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in t.toxicity(docs, some).collect()} == {0}
    assert {r.predicted for r in t.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1}
    assert t.toxicity(docs.limit(0), labels).count() == 0
