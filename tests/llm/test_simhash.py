"""Fingerprints, Golay keys, links and components against plain Python."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Row, functions as F

from tessera.llm import simhash as s

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rid int"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def test_golay_indices_are_shared_within_two_bits():
    high, errors, counts = tables = s.golay_tables()
    assert sorted(Counter(counts.tolist()).items()) == [(1, 277), (6, 1771)]
    rng = np.random.default_rng(1)
    base = np.concatenate([errors[np.arange(2048), 0], rng.integers(0, 1 << 23, 500)])
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]

    def keys(words):
        at, idx = s.golay_indices(words, tables)
        out = [set() for _ in words]
        for a, i in zip(at.tolist(), idx.tolist()):
            out[a].add(i)
        return out

    mine = keys(base)
    for f in flips:
        assert all(a & b for a, b in zip(mine, keys(base ^ f)))


def corpus():
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "One", "one two", "a b c", "A  b\tC", "é À Z z", "x " * 50]
    for _ in range(25):
        base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.choice([5, 80, 400]))]
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(99)
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    ids[-1] = None
    return ids + [ids[3]], texts + [texts[3]]


def test_against_brute_force(spark):
    ids, texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", None, 1, "x", 1) for i, t in zip(ids, texts)], SCHEMA)
    got = s.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = Counter(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c: 1 for c in {c for _, _, c in want}})


def test_dense_balls_and_chains(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(63)
    fps = {centre} | {centre ^ 1 << b for b in range(60)} | {centre ^ 1 << b ^ 1 << b + 1 for b in range(0, 60, 2)}
    chain = rnd.getrandbits(63)
    for step in range(40):
        chain ^= 1 << (step % 60) | 1 << (step * 7 % 60)
        fps.add(chain)
    fps |= {rnd.getrandbits(63) for _ in range(60)}
    fps = sorted(fps)
    df = s.stage(spark.createDataFrame([Row(fp=f) for f in fps]), "test")
    want = brute_components(fps, fps)
    for bucket in (1, 3, 24, 10_000):
        roots = {r.node: r.root for r in s.components(s.links(df, bucket)).collect()}
        got = [roots.get(f, f) for f in fps]
        groups = lambda labels: sorted(sorted(f for f, x in zip(fps, labels) if x == y) for y in set(labels))
        assert groups(got) == groups(want), bucket


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert s.near_duplicates(docs).count() == 0
    assert s.keep_one(docs).count() == 0


def test_hash_is_sparks_xxhash64(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    assert spark.range(1).select(s.fingerprints(F.lit("a b c"))).first()[0] == got
