"""Retrieval packing: ids against the library, BM25 against plain Python, windows and odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as p

SCHEMA = "doc_id long, text string, ids string, key string, start int"
ODD = ["", " ", "  ", "a", " a", "it's, he said: \"no.\"", "a.\nb", "x.\n\ny", "end,###", "a<|endoftext|>,", "it' s", "a ", "a  b", "a b", "a \n b", "a\n b", "tab\t x", "a  b", "a 　b", "it's we'll I'm", "x <|endoftext|> y",
       "<|endoftext|>", "a<|endoftext|> b", "a <|endoftext|>", "\x1c a \x1d b", "é è", "日本 語", "12 34,5 6", "a​ b", "ab" * 5000, "🙂 🙂🙂", "- -- ---", "\r\n x", "end \u0085 x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(p.default_tokenizer())


@pytest.fixture(scope="module")
def model():
    with open(p.default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [p.END]


def test_ids(library, model):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice([" ", " ", "a", "b", "\n", "'", "é", "1", "\u3000", ".", "s", "\x85", "\xa0", "ß", "½", "\u2014"]) for _ in range(60)) for _ in range(500)]
    texts += ["".join(chr(c) for c in range(0x250) if c != 0) * 2, " ".join(chr(c) for c in range(1, 0x250)), " " * 100_000 + "x", "ab" * 300_000, "q" * (p.LONG + 1)]
    enc = p.Encoder(model)
    assert enc.ranks is not None
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [whole(library, t) for t in texts]


def test_other_tokenizers_are_asked_themselves():
    from public_tokenizers import path

    with open(path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = p.Encoder(f.read())
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    assert enc.ranks is None
    assert [np.frombuffer(b, enc.dtype).tolist()[:-1] for b in enc.encode(ODD)] == [own.encode(t, add_special_tokens=False).ids for t in ODD]


def test_bm25_and_document_counts(spark):
    rnd = random.Random(2)
    docs = [np.array([rnd.randrange(40) for _ in range(rnd.randrange(1, 60))] + [1]) for _ in range(50)]
    df = Counter(t for d in docs for t in set(d[:-1].tolist()))
    idf = np.array([math.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(40)])
    mean = sum(len(d) - 1 for d in docs) / 50
    index = p.Index(docs, idf, mean)
    for q in range(50):
        want = []
        for d in docs:
            tf = Counter(d[:-1].tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * (len(d) - 1) / mean)) for t in set(docs[q][:-1].tolist()) if tf[t]))
        assert np.allclose(index.scores(q), want, rtol=1e-12)
    packed = spark.createDataFrame([(bytearray(np.bincount(list(set(d[:-1].tolist())), minlength=40).astype(np.int64).tobytes()),) for d in docs] + [(None,)], "df binary")
    assert p.document_counts(packed, 40).tolist() == [df[t] for t in range(40)]


def brute_pack(docs, idf, mean, window):
    """The same rule in plain Python: best unused document first, the one that does not fit is cut."""
    left = {d: len(ids) % window for d, ids in enumerate(docs)}
    start = {d: len(ids) - left[d] for d, ids in enumerate(docs)}
    out = [[(d, a, window)] for d, ids in enumerate(docs) for a in range(0, start[d], window)]
    unused = {d for d in left if left[d]}
    score = p.Index(docs, idf, mean).scores
    rest = None
    while rest or unused:
        if not rest:
            d = min(unused, key=lambda d: (-left[d], d))
            unused.discard(d)
            rest = (d, start[d], left[d])
        seq, rest = [rest], None
        scores = score(seq[0][0])
        while sum(x[2] for x in seq) < window and unused:
            d = min(unused, key=lambda d: (-scores[d], d))
            unused.discard(d)
            n = min(left[d], window - sum(x[2] for x in seq))
            seq.append((d, start[d], n))
            if n < left[d]:
                rest = (d, start[d] + n, left[d] - n)
        out.append(seq)
    return out


def test_shard_against_brute_force():
    rnd = random.Random(3)
    for trial in range(20):
        docs = [np.array([rnd.randrange(30) for _ in range(rnd.choice([0, 1, 5, 9, 40, 63, 64, 200]))] + [1]) for _ in range(rnd.randrange(1, 40))]
        idf, mean = np.linspace(0.1, 2, 30), 30.0
        got, want = p.pack_shard(docs, p.Index(docs, idf, mean), 64), brute_pack(docs, idf, mean, 64)
        if want and sum(x[2] for x in want[-1]) < 64:  # the last one is cut into powers of two
            tail = want.pop()
            sizes = [sum(x[2] for x in s) for s in got[len(want):]]
            assert sizes == p.powers(sum(x[2] for x in tail))
            ids = lambda seqs: [(d, i) for s in seqs for d, a, n in s for i in range(a, a + n)]
            assert ids(got[len(want):]) == ids([tail])
            got = got[: len(want)]
        assert got == want


def check(got, rows, library, window):
    """Every id once, whole windows, gapless offsets."""
    sequences, pieces, docs = defaultdict(list), Counter(), Counter()
    by = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, n in parts:
            assert offset == at and n > 0
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        docs[doc_id, tuple(whole(library, text))] = sum((r[0], r[1]) == (doc_id, text) for r in rows)
    for (doc_id, ids), n in docs.items():
        want = Counter()
        parts = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[doc_id] if r.doc_tokens == len(ids))
        for (a, length, crc, _), k in parts.items():
            if zlib.crc32(np.array(ids[a : a + length], "<u4").tobytes()) == crc:
                for i in range(a, a + length):
                    want[i] += k
        assert all(want[i] >= n for i in range(len(ids))), (doc_id, n)
    total = sum(len(whole(library, r[1])) for r in rows)
    assert sum(r.length for r in got) == total
    return pieces


def test_windows(spark, library):
    rnd = random.Random(4)
    topics = [[f"{c}{i}word" for i in range(60)] for c in "qxz"]
    rows = [(i, " ".join(rnd.choices(topics[i % 3], k=rnd.randrange(20, 300)))) for i in range(120)]
    rows += [(500, "same text here"), (500, "same text here"), (501, None), (502, ""), (None, "no id at all"), (503, "long " * 30_000)]
    rows += [(600 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "i", "k", 1) for r in rows], SCHEMA).repartition(6)
    got = p.packed_windows(df, window=512).collect()
    check(got, rows, library, 512)
    # neighbours share words: most windows of short documents hold one topic
    seqs = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id < 120:
            seqs[r.sequence_id].add(r.doc_id % 3)
    assert sum(len(s) == 1 for s in seqs.values()) > 0.7 * len(seqs)
    small = p.packed_windows(df, window=512, shard_tokens=5_000).collect()
    check(small, rows, library, 512)


def test_real_ids_and_empty(spark, library):
    df = spark.createDataFrame([(7, "one two three", "i", "k", 1)], SCHEMA)
    got = p.pack(df).collect()
    ids = whole(library, "one two three")
    assert [x for r in sorted(got, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
    out = p.packed_windows(df.limit(0))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() == 0
