"""Base counts against plain Python; planted outliers; degenerate groups; odd rows."""

import random
import re
from collections import Counter

import numpy as np

from tessera.llm import quality as q
from tessera.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, grp int, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + d for i, w in enumerate(windows) if w in often for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(8)
    out = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x x x x", "é ñ 𝄞 #*$%&|<>", "a\x0bb\x0cc\rd", "l\nl\n l\nl\n\n \n", "a b c d a b c", "\x1c a b"]
    for n in (10, 60, 400, 3000):
        for vocabulary in (2, 4, 30, 2000):
            words = [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
            out.append("".join(w + rnd.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    return out


def test_base_counts(spark):
    rows = [(i, t, "en", "s", "clash", 1, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in q.text_statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        want = brute(t)
        assert tuple(got[i][c] for c in q.COUNTS) == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def numpy_model(x):
    """Concentration steps with exact quantiles."""
    floor = np.array(list(q.FLOORS.values()))

    def estimate(part, factor):
        m = part.mean(0)
        return m, np.cov(part.T, bias=True) * factor + np.diag(floor ** 2)

    def far(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    m, c = np.median(x, 0), np.diag(np.maximum(np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.35, floor) ** 2)
    size = np.inf
    while True:  # until the determinant rests
        d = far(m, c)
        m, c = estimate(x[d <= np.quantile(d, q.SUPPORT)], q.CONSISTENCY)
        if np.linalg.slogdet(c)[1] / 2 >= size - q.SETTLED:
            break
        size = np.linalg.slogdet(c)[1] / 2
    m, c = estimate(x[far(m, c) <= q.REWEIGHT], 1.0)
    return far(m, c)


def test_outliers_against_numpy(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(700):
        n = int(60 * 2 ** (rnd.random() * 4))
        words = ["".join(rnd.choice("aeioubcdst") for _ in range(rnd.randint(2, 8))) for _ in range(n)]
        if i % 20 == 0:  # junk: symbols on every word
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "s" if i % 3 else None, "c", 1, "c"))
    stats = q.quality_verdicts(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in stats.collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in got if i % 20 == 0}
    for lang, source in [("en", "s"), (None, "s"), ("en", None), (None, None)]:
        ids = [r[0] for r in rows if (r[2], r[3]) == (lang, source)]
        if len(ids) < 100:
            continue
        n = np.array([[getattr(got[i], c) for c in q.COUNTS] for i in ids], float)
        x = np.column_stack([np.log1p(n[:, 0]), np.log1p(n[:, 1] / n[:, 0]), *(np.sqrt(n[:, k] / n[:, 0]) for k in (2, 3, 4))])
        assert np.allclose([got[i].d2 for i in ids], numpy_model(x), rtol=0.05, atol=0.05)


def test_small_groups_empty_tables_and_filter(spark):
    rows = [(i, t, random.Random(i).choice(["en", None]), f"s{i}", "c", 1, "c") for i, t in enumerate(texts())]
    rows += rows[-3:]
    df = spark.createDataFrame(rows, SCHEMA)
    out = q.quality_verdicts(df).collect()
    assert len(out) == len(rows) and all(r.kept == (not r.base_failed) and r.d2 is None for r in out)
    kept = q.quality_filter(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert kept.count() == sum(r.kept for r in out)
    assert q.quality_verdicts(df.limit(0)).count() == q.quality_filter(df.limit(0)).count() == 0


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents")
    rows = q.quality_verdicts(docs).join(read_table(spark, d, "labels"), "doc_id").filter("not base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    plan = q.quality_verdicts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_steps_write_two_tables_and_plans_name_parameters_once(spark, monkeypatch):
    """A step reads the rows once and writes sums and estimates; its distance stays short inside a filter."""
    written = []
    stage = q.stage
    monkeypatch.setattr(q, "stage", lambda df, name: written.append(name) or stage(df, name))
    rnd = random.Random(3)
    rows = [("en", "s", n, n * rnd.randint(3, 7), rnd.randrange(9), rnd.randrange(4), rnd.randrange(20), False)
            for n in (rnd.randint(50, 900) for _ in range(300))]
    stats = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    groups, model = q.mcd_model(stats)
    steps = written.count("mcd-histogram")
    assert steps >= 2 and len(written) <= 5 + 2 * steps
    rows = q._with_group(stats, groups).withColumns(q._vector())
    plan = q._distance(rows, model).filter("d2 <= 30")._jdf.queryExecution().optimizedPlan().toString()
    plan = "\n".join(x for x in plan.split("\n") if "Relation" not in x and "Project" not in x and "isnotnull(grp" not in x)
    factor = [c for c in model.columns if c[0] in "lw"]
    assert len(factor) == 15 and {plan.count(f"{c}#") for c in factor} == {1}, plan
