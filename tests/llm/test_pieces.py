"""Unigram Viterbi against the public library and brute force; exact round trips."""

import random

import pytest

from tessera.llm import pieces as p

TEXTS = ["", " ", "Hello world", "  two  blanks ", "\n\n a\tb\r\nc", "ça va, où? ñandú!", "𝄞 ▁ x▁y▁", "日本語 text ", "a" * 5000, "x\x00y", "word***, %%% (end). \"q\" it's", "ÉÀ́", "▁"]


@pytest.fixture(scope="module")
def model():
    return p.Unigram(p.read_pieces())


def best_score(model, part):
    """Exhaustive best score over all segmentations, by recursion on the first piece."""
    if not hasattr(model, "known"):
        model.known = {x: i for i, x in enumerate(model.pieces) if model.bytes_of[i] and i not in set(model.byte_ids)}
    ids = model.known
    memo = {"": 0.0}

    def best(s):
        if s not in memo:
            options = [model.scores[ids[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in ids]
            if s[0] not in ids:
                options.append(model.unknown + best(s[1:]))
            memo[s] = max(options)
        return memo[s]

    return best(part)


def total(model, ids):
    out, k = 0.0, 0
    while k < len(ids):
        if ids[k] in model.byte_ids:
            lead = model.byte_ids.index(ids[k])
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out += model.unknown
        else:
            out += model.scores[ids[k]]
            k += 1
    return out


def words(n):
    rnd = random.Random(4)
    syllables = "the re ing tion é ch sch ung ß ño que , . *** %%% ( ' | Ti EA 4 7 日 𝄞".split()
    return ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 6))) for _ in range(n)]


def test_viterbi_is_optimal(model):
    for w in words(300):
        assert total(model, model.viterbi("▁" + w)) == pytest.approx(best_score(model, "▁" + w)), w
    for t in [" ".join(words(300)[k:k + 8]) for k in range(0, 300, 8)]:
        assert total(model, model.encode(t)) == pytest.approx(best_score(model, "▁" + t.replace(" ", "▁"))), t


def test_against_the_library(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(p.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # unigram
    for piece, score in zip(proto.pieces, p.read_pieces()["scores"]):
        piece.score = score
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    known = [w for w in words(400) if "日" not in w and "𝄞" not in w]
    assert len(known) > 200
    for w in known:
        assert total(model, model.encode(w)) == pytest.approx(total(model, lib.encode(w))), w
    for t in TEXTS:
        if "▁" not in t:
            assert lib.decode(model.encode(t)) == t


def test_round_trip(model):
    for t in TEXTS + [" ".join(words(200))]:
        assert model.decode(model.encode(t)) == t


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"\xff\x00", b"b", b"\x00", b"ba"]
    base, check, value = p.double_array(keys, list(range(len(keys))))

    def find(key):
        node = 0
        for c in key:
            nxt = base[node] + c
            if nxt == 0 or check[nxt] != node:
                return -1
            node = nxt
        return value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"ac", b"c", b"abcd", b"\xff", b"")] == [-1] * 5


def test_spark(spark, model):
    rows = [(i, t, "ids") for i, t in enumerate([None, *TEXTS])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = p.tokens(df).collect()
    assert sorted((r.doc_id, r.ids) for r in out if r.doc_id) == sorted((i, model.encode(t)) for i, t, _ in rows if t is not None)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out if r.doc_id) and [r.ids for r in out if not r.doc_id] == [None, None]
    wide = p.with_tokens(df)
    assert wide.columns == ["doc_id", "text", "ids", "ids_1"]
    back = p.decode(wide, "ids_1", text="again")
    assert all(r.again == r.text for r in back.collect())
    assert p.tokens(df.limit(0)).count() == 0
