"""The pipeline's stages in order, each against its operator or a brute-force rule."""

import random

import corpus_pipeline as cp
from tessera.llm import decontaminate, pieces, quality, simhash
from tessera.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "private_data", "sentencepiece_tokens"]


def test_run_follows_the_stages(spark):
    docs = read_table(spark, SF, "documents")
    out = cp.run(spark, SF)
    assert out.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in out.collect()}
    source = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id for r in quality.quality_verdicts(docs).collect() if r.kept}
    prints = {i: simhash.fingerprint(source[i].text) for i in kept}
    group = {i: i for i in kept}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    single = {i for i in kept if root(i) == i}
    items = read_table(spark, SF, "benchmark")
    dirty = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    assert set(rows) == single - dirty
    model = pieces.Unigram(pieces.read_pieces())
    changed = 0
    for i, r in rows.items():
        assert (r.lang, r.source) == (source[i].lang, source[i].source)
        assert model.decode(r.ids) == r.text and r.n_chars == len(r.text)
        changed += r.text != source[i].text
    assert 0 < changed < len(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    rnd = random.Random(1)
    body = " ".join("w%d" % rnd.randrange(500) for _ in range(80))
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, body, None, None, None, "x"), (3, body, None, None, None, "x"), (None, body + " a@b.cc", "en", None, 1, "x"), (5, "z " * 200_000, "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, body)], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "ids_1"]
    # the row without an id is a near copy of 3 only if the fingerprints differ in at most two bits
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect() if r.doc_id in (3, None)}
    apart = (prints[3] ^ prints[None]).bit_count()
    assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is None, i)) == ([3] if apart <= 2 else [3, None])
    empty = str(tmp_path / "none")
    spark.createDataFrame([], schema).write.parquet(empty + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(empty + "/benchmark.parquet")
    assert cp.run(spark, empty).count() == 0


def test_tables_of_earlier_stages_go(spark, tmp_path):
    """A stage removes what the stage before it wrote, but not what its own documents still read."""
    docs = read_table(spark, SF, "documents")
    first = cp.quality_rules(spark, docs, SF)
    left = cp._LEFT[spark.sparkContext.applicationId]
    mine = list(left)
    assert mine
    lazy = cp.private_data(spark, first, SF)  # reads the first stage's tables
    assert lazy.count() == first.count() > 0
    first.write.parquet(str(tmp_path / "first"))
    again = cp.private_data(spark, spark.read.parquet(str(tmp_path / "first")), SF)
    assert not set(mine) & set(left) and again.count() > 0
