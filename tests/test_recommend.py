"""Recommendation: the hand-computed fixture, the status rules, and a brute-force
comparison on random catalogues (duplicates, ':'-variants, tied extremes) that exercises
both the shared class path and the exact fallback path."""

import math
import random

import pytest

from tessera import constants as C
from tessera.operators.recommend import recommend

FEATS = [f"GAME_CAT_f{i}" for i in range(9)]
SCHEMA = "game_name string, game_id long, popularity_score double, avg_rating double, num_rates int, " + \
    ", ".join(f"{f} int" for f in FEATS)


def _items(spark, rows):
    return spark.createDataFrame([(n, i, p, a, c, *v) for (n, i, p, a, c, v) in rows], SCHEMA)


def _members(spark, pairs):
    return spark.createDataFrame(pairs, "cluster_id int, game_name string")


def bits(s):
    return [int(ch) for ch in s]


FIXTURE = [
    ("Alpha", 1, 0.3, 7.0, 50, bits("000000000")),
    ("Alpha: Expansion", 2, 0.4, 7.0, 50, bits("000000000")),
    ("Beta", 3, 0.9, 8.0, 100, bits("000000000")),
    ("Gamma", 4, 0.5, 7.0, 400, bits("000000001")),
    ("Eps", 5, 0.2, 6.0, 20, bits("000000011")),
    ("Delta", 6, 1.0, 9.0, 1000, bits("111111111")),
]


def test_fixture_alpha(spark):
    items = _items(spark, FIXTURE)
    members = _members(spark, [(0, r[0]) for r in FIXTURE])
    inputs = spark.createDataFrame([("Alpha",)], "input string")
    recs, status = recommend(items, members, inputs, features=FEATS)
    got = [(r["item"], round(r["final_score"], 6), r["explanation"]) for r in recs.orderBy("rank").collect()]
    assert [g[0] for g in got] == ["Beta", "Gamma"]
    assert got[0][1] == pytest.approx(0.910840, abs=1e-6)
    assert got[1][1] == pytest.approx(0.460417, abs=1e-6)
    assert got[0][2] == ("This game is very similar to your selected game and it's also popular among board game "
                         "enthusiasts and it's well-rated by the community.")
    assert got[1][2] == "This game shares many characteristics with your selected game."
    assert status.first()["status"] == C.STATUS_OK


def test_statuses(spark):
    rows = [
        ("Solo", 1, 0.5, 7.0, 30, bits("000000000")),
        ("P1", 2, 0.5, 7.0, 30, bits("000000000")),
        ("P2", 3, 0.6, 7.5, 30, bits("100000000")),
        ("S1", 4, 0.5, 7.0, 30, bits("000000001")),
        ("S2", 5, 0.6, 7.5, 30, bits("000000001")),
        ("S3", 6, 0.7, 8.0, 30, bits("000000001")),
    ]
    members = _members(spark, [(0, "Solo"), (1, "P1"), (1, "P2"), (2, "S1"), (2, "S2"), (2, "S3")])
    inputs = spark.createDataFrame([(x,) for x in ["Solo", "P1", "S1", "Nope"]], "input string")
    _, status = recommend(_items(spark, rows), members, inputs, features=FEATS)
    got = {r["input"]: r["status"] for r in status.collect()}
    assert got["Solo"] == C.STATUS_NO_OTHER
    assert got["P1"] == "No games similar enough to 'P1' were found"       # one candidate -> constant distance
    assert got["S1"] == "No games similar enough to 'S1' were found"       # all candidates identical
    assert got["Nope"] == "Game 'Nope' not found in any cluster"


# ----------------------------------------------------------------- brute force
def _rq(avg, n):
    z = C.WILSON_Z
    p = avg / 10.0
    return (p + z * z / (2.0 * n) + z * math.sqrt(p * (1.0 - p) / n + z * z / (4.0 * (n * n)))) / (1.0 + z * z / n)


def brute(rows, members, k=5):
    names = {}
    for cl, key in members:
        names.setdefault(cl, set()).add(key)
    out = {}
    for x in sorted({r[0] for r in rows}):
        cls = sorted(c for c, ns in names.items() if x in ns)
        if not cls:
            continue
        c = cls[0]
        pool = sorted([r for r in rows if r[0] in names[c]], key=lambda r: r[1])
        first = {}
        for r in pool:
            first.setdefault(r[0], r[5])
        base = x.strip().lower() + ":"
        cands = [r for r in pool if r[0] != x and not r[0].lower().startswith(base)]
        if not cands or len(names[c] - {x}) == 0:
            continue
        u = first[x]
        sc = []
        for r in cands:
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(u, first[r[0]])))
            sc.append((r, r[2], _rq(r[3], r[4]), d))
        lo = [min(s[i] for s in sc) for i in (1, 2, 3)]
        hi = [max(s[i] for s in sc) for i in (1, 2, 3)]
        norm = lambda v, i: (v - lo[i]) / (hi[i] - lo[i]) if hi[i] != lo[i] else 1.0
        kept = []
        for r, p, q, d in sc:
            pn, rn, dn = norm(p, 0), norm(q, 1), norm(d, 2)
            if dn <= 0.4:
                kept.append((pn * 0.25 + (1.0 - dn) * 0.55 + rn * 0.20, r[1]))
        kept.sort(key=lambda t: (-t[0], t[1]))
        out[x] = [(rid, round(f, 9)) for f, rid in kept[:k]]
    return out


def random_catalogue(seed):
    rnd = random.Random(seed)
    bases = ["Ark", "Bolt", "Cog", "Dune", "Echo", "Fjord"]
    rows, members = [], set()
    for rid in range(1, 90):
        b = rnd.choice(bases)
        name = rnd.choice([b, b, f"{b}: Ext {rnd.randint(1, 3)}", f"{b}: Ext 1: Mini", f" {b}"])
        vec = [rnd.randint(0, 1) if i < 4 else 0 for i in range(9)]
        pop = rnd.choice([0.1, 0.2, 0.5, 0.9, 1.0])
        rows.append((name, rid, pop, rnd.choice([6.0, 6.5, 7.25, 9.0]), rnd.choice([20, 50, 400]), vec))
        members.add((rnd.randint(0, 2), name))
    return rows, sorted(members)


@pytest.mark.parametrize("seed,cap", [(1, 32), (2, 32), (3, 0), (4, 2)])
def test_matches_brute_force(spark, seed, cap):
    rows, members = random_catalogue(seed)
    recs, _ = recommend(_items(spark, rows), _members(spark, members), features=FEATS, exclusion_cap=cap)
    got = {}
    for r in recs.collect():
        got.setdefault(r["input"], []).append((r["rank"], r["item_id"], round(r["final_score"], 9)))
    got = {x: [(rid, f) for _, rid, f in sorted(v)] for x, v in got.items()}
    want = brute(rows, members)
    assert {x: v for x, v in want.items() if v} == got


def test_extreme_held_by_variant_takes_exact_path(spark):
    """The only max-popularity row is a ':'-variant of the input: the input's ranges must be
    recomputed without it (exact path), and results still equal the brute force."""
    rows = [
        ("Ark", 1, 0.5, 7.0, 50, bits("000000000")),
        ("Ark: Big Box", 2, 1.0, 9.0, 500, bits("000000001")),   # sole holder of pmax and rmax
        ("Bolt", 3, 0.2, 6.0, 20, bits("000000001")),
        ("Cog", 4, 0.6, 7.5, 100, bits("000000011")),
        ("Dune", 5, 0.4, 8.0, 60, bits("000000111")),
        ("Echo", 6, 0.3, 6.5, 30, bits("000001111")),
    ]
    members = [(0, r[0]) for r in rows]
    recs, _ = recommend(_items(spark, rows), _members(spark, members), features=FEATS)
    got = {}
    for r in recs.collect():
        got.setdefault(r["input"], []).append((r["rank"], r["item_id"], round(r["final_score"], 9)))
    got = {x: [(rid, f) for _, rid, f in sorted(v)] for x, v in got.items()}
    want = {x: v for x, v in brute(rows, members).items() if v}
    assert got == want and "Ark" in got


def test_salted_path_matches_brute_force(spark):
    """broadcast_bytes=0 forces the salted vector-pair join and shuffle joins everywhere."""
    rows, members = random_catalogue(11)
    recs, _ = recommend(_items(spark, rows), _members(spark, members), features=FEATS, broadcast_bytes=0)
    got = {}
    for r in recs.collect():
        got.setdefault(r["input"], []).append((r["rank"], r["item_id"], round(r["final_score"], 9)))
    got = {x: [(rid, f) for _, rid, f in sorted(v)] for x, v in got.items()}
    assert got == {x: v for x, v in brute(rows, members).items() if v}


def variant_heavy_catalogue(seed):
    """Few bases, many ':'-variants (incl. 'Name:' and lower-case), padded names, names in
    two clusters, and tied popularity/rating values at the extremes."""
    rnd = random.Random(seed)
    bases = ["Ark", "Bolt", "Cog"]
    rows, members = [], set()
    for rid in range(1, rnd.randint(40, 120)):
        b = rnd.choice(bases)
        name = rnd.choice([b, f"{b}: X", f"{b}: X: Y", f"{b}:", f"{b.lower()}: z", f"{b}  "])
        vec = [rnd.randint(0, 1) if i < rnd.choice([2, 3, 5]) else 0 for i in range(9)]
        rows.append((name, rid, rnd.choice([0.1, 0.5, 1.0]), rnd.choice([6.0, 9.0]), rnd.choice([20, 400]), vec))
        for _ in range(rnd.randint(1, 2)):
            members.add((rnd.randint(0, 3), name))
    return rows, sorted(members)


@pytest.mark.parametrize("seed,cap", [(20, 32), (23, 1)])
def test_variant_heavy_matches_brute_force(spark, seed, cap):
    rows, members = variant_heavy_catalogue(seed)
    recs, _ = recommend(_items(spark, rows), _members(spark, members), features=FEATS, exclusion_cap=cap)
    got = {}
    for r in recs.collect():
        got.setdefault(r["input"], []).append((r["rank"], r["item_id"], round(r["final_score"], 9)))
    got = {x: [(rid, f) for _, rid, f in sorted(v)] for x, v in got.items()}
    assert got == {x: v for x, v in brute(rows, members).items() if v}


def near_ties(groups=30):
    """Two kinds of rows whose partial scores tie up to rounding, at one distance, many of each;
    which kind wins is decided in the last bits of the final score."""
    rows = [("In", 1, 0.0, 5.0, 20, bits("000000000")), ("Far", 2, 1.0, 9.0, 400, bits("111111111"))]
    lo, hi = _rq(5.0, 20), _rq(9.0, 400)
    rid = 3
    for i in range(groups):
        rows.append((f"X{i}", rid, 0.9, 6.0, 400, bits("111000000")))
        rid += 1
    target = 0.25 * 0.9 + 0.2 * (_rq(6.0, 400) - lo) / (hi - lo)
    for i in range(groups):
        pop = (target - 0.2 * (_rq(8.0, 400) - lo) / (hi - lo)) / 0.25
        rows.append((f"Y{i}", rid, pop, 8.0, 400, bits("000000111")))
        rows.append((f"Z{i}", rid + 1000, pop + i % 3 * 1e-17, 8.0, 400, bits("111000000")))
        rid += 1
    return rows, [(0, r[0]) for r in rows]


def test_near_ties_are_exact_for_every_path(spark):
    rows, members = near_ties()
    want = brute(rows, members)["In"]
    got = {}
    for cap in (32, 0, -1, 7):
        recs, _ = recommend(_items(spark, rows), _members(spark, members), spark.createDataFrame([("In",)], "input string"),
                            features=FEATS, exclusion_cap=cap, max_distance=1.0)
        got[cap] = [(r["item_id"], r["final_score"]) for r in recs.orderBy("rank").collect()]
    assert got[32] == got[0] == got[-1] == got[7] and len(got[32]) == C.TOP_K
    assert [f for _, f in want] and got[32][0][1] >= got[32][-1][1]
