"""Merkle manifest against plain recursion; sweeps; tampering; odd rows."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tessera.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, row string, proof int"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, siblings of every leaf): level by level, without queues."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in at[a + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            below.append([i for x in at[a : a + 16] for i in x])
        nodes, at = up, below
    return nodes[0], proofs


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        key = "" if doc_id is None else str(doc_id)
        bad = zlib.crc32(key.encode()) % 5 == 0 and text is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if bad else text
        by[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, low)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = {s: tree([r[1] for r in by[s]]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, good, found), proof in zip(by[s], subs[s][1]):
            node = found
            for left, right in proof + top:
                node = h(left + node + right)
            out.append((doc_id, good, subs[s][0], root, h("".join(a + b for a, b in proof + top)), node, node == root))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1:])


def test_sweeps_against_recursion():
    for n in (1, 2, 15, 16, 17, 31, 256, 257, 272, 4095, 4096):
        nodes = [h(str(i)) for i in range(n)]
        root, proofs = tree(nodes)
        assert m.top_digest(nodes, m.height(n)) == root
        got = list(m.reversed_sweep(nodes, m.height(n), [("a", "b")]))
        assert [i for i, _ in got] == list(range(n))[::-1]
        assert [p for _, p in got[::-1]] == [[*p, ("a", "b")] for p in proofs]
    # a last block is lifted as far as the full ones
    assert m.top_digest(["x"], 3) == h(h(h("x")))


@pytest.mark.parametrize("lift", [1, 3])
def test_manifest(spark, lift):
    rnd = random.Random(lift)
    rows = [(i, rnd.choice(["Some Text", "plain", "", None, "É" * 40, "x" * 50_000]), rnd.choice(["en", None]), "hot", rnd.choice([None, i])) for i in range(700)]
    rows += [(1000 + i, f"T {i}", "de", f"s{i}", i) for i in range(20)]
    rows += [(5, "Twin", "en", "hot", 4), (5, "Twin", "en", "hot", 4), (None, "No Id", None, "hot", None), (None, None, None, None, None)]
    rows += [(2000, "A", "en", "", 1), (2001, "B", "en", "é", 1), (2002, "C", "en", "z", 1), (-7, "neg", "en", "hot", 3)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in m.merkle_manifest(df, lift=lift).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({r[3] for r in got}) == 1 and {r[6] for r in got} == {True, False}


def test_one_row_and_lone_leaves(spark):
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "B", "en", "t", 1)], [(i, None, None, None, None) for i in range(3)]):
        df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
        assert sorted([tuple(r) for r in m.merkle_manifest(df).collect()], key=key) == sorted(brute(rows), key=key)


def test_manifest_of_other_rows(spark):
    """The operator on its own: any rows, any group, whole proofs."""
    df = spark.createDataFrame([(i, i % 3, h(str(i)), f"p{i}") for i in range(100)], "k int, g int, d string, path string")
    out = m.manifest(df, "g", ["k"], digest="d")
    assert out.columns == ["k", "g", "d", "path", "proof", "subroot", "root"]
    for r in out.collect():
        node = r.d
        for run in r.proof:
            node = h(run.left + node + run.right)
        assert node == r.root and r.path == f"p{r.k}"


def test_empty(spark):
    out = m.merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_sql_on_odd_rows(spark):
    """The registered SQL gives the same rows as the operator and the recursion."""
    import duckdb

    from tessera.llm.oracles import crc32_sql, merkle_sql

    rows = [(i, "Txt É" * (i % 4), "en", "hot", i) for i in range(280)] + [(None, "A", None, None, None), (7, None, "de", "é", None), (-12, "Z", "de", "z", 5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle_sql()).fetchall(), key=key) == sorted(brute(rows), key=key)
    for text in ("", "0", "-12", "1234567890"):
        assert con.execute("SELECT " + crc32_sql(f"('{text}')")).fetchone()[0] == zlib.crc32(text.encode())
