"""Containment search against plain Python sets."""

import random
from collections import Counter

import pytest
import regex

from tessera.llm import decontaminate as d

DOCS = "doc_id long, text string, lang string, source string, text_key string, item_key int"
ITEMS = "item_id long, text string, text_key int"


UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def words(text):
    return regex.findall(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])[\p{{L}}\p{{M}}\p{{N}}])+", (text or "").lower())


def windows(ws, n):
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items):
    """An item of under five words is one window of its own length."""
    out = Counter()
    for doc_id, text in docs:
        mine = words(text)
        for item_id, item in items:
            ws = words(item)
            n = min(5, len(ws))
            q = windows(ws, n) if ws else set()
            shared = windows(mine, n) & q if ws else set()
            if q and 5 * len(shared) >= 4 * len(q):
                out[doc_id, item_id, len(shared), len(q)] += 1
    return out


def corpus():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["al", "be", "ça", "do", "el", "Fo"]) + rnd.choice(["ra", "ni", "tu", "77", "ße"]) + rnd.choice(["x", "y", ""])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([4, 5, 6, 9, 12, 20, 33, 60, 100, 5])]
    items += [(50, None), (51, ""), (52, "?!"), (53, items[4][1]), (54, items[3][1].upper()), (4, items[5][1]), (60, "one two")]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "One, two!"), (4, "one two three"), (5, text(3000))]
    for k in range(60):
        body = text(rnd.choice([0, 30, 800])).split()
        for _ in range(rnd.choice([0, 1, 2])):
            part = (items[rnd.randrange(10)][1]).split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if len(part) > 3:
                    part[rnd.randrange(len(part))] = "changed"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((10 + k, ("\n" if k % 2 else " , ").join(body)))
    return docs + [docs[20], docs[20], (None, docs[20][1])], items


@pytest.mark.parametrize("inline", [d.INLINE, 0])
def test_against_brute_force(spark, inline):
    docs, items = corpus()
    ddf = spark.createDataFrame([(i, t, "en", None, "k", 1) for i, t in docs], DOCS)
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contaminated(ddf, idf, inline=inline).collect())
    want = brute(docs, items)
    assert got == want and len(want) > 20
    dirty = {w[0] for w in want}
    clean = d.decontaminate(ddf, idf, inline=inline)
    assert clean.columns == ddf.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in docs if x[0] not in dirty)


def test_short_items_in_long_texts(spark):
    rnd = random.Random(6)
    filler = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet".split()) + str(rnd.randrange(99)) for _ in range(n))
    items = [(1, "The answer to life"), (2, "Quick: brown!"), (3, "zebra"), (4, "one two three"), (5, "北京大学图书馆在哪里"), (6, "สวัสดี"), (7, "ここ"), (8, "a longer item of seven plain words")]
    docs = [(k, f"{filler(300)} {item.upper()}. {filler(300)}") for k, item in items] + [(20, "我想知道北京大学图书馆在哪里啊,谢谢"), (21, filler(400)), (22, "answer to life"), (23, "the-answer to\nlife"), (24, "こ こ")]
    ddf = spark.createDataFrame([(i, t, "en", None, "k", 1) for i, t in docs], DOCS)
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    for inline in (d.INLINE, 0):
        got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contaminated(ddf, idf, inline=inline).collect())
        assert got == brute(docs, items)
    assert {(i, i) for i, _ in items} | {(20, 5), (23, 1), (24, 7)} == {k[:2] for k in got}
    assert {r.doc_id for r in d.decontaminate(ddf, idf).collect()} == {21, 22}


def test_empty_tables(spark):
    docs, items = corpus()
    ddf = spark.createDataFrame([(i, t, "en", None, "k", 1) for i, t in docs], DOCS)
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    assert d.contaminated(ddf.limit(0), idf).count() == 0
    assert d.contaminated(ddf, idf.limit(0)).count() == 0
    assert d.decontaminate(ddf, idf.limit(0)).count() == ddf.count()


def test_no_python_in_the_plan(spark):
    docs, items = corpus()
    ddf = spark.createDataFrame([(i, t, "en", None, "k", 1) for i, t in docs], DOCS)
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    plan = d.contaminated(ddf, idf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
