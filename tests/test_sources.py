"""Snapshot names, staleness boundary, feedback parsing, nested extraction rules."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.sources import feedback as FB
from tessera.sources import snapshots as SN


def test_snapshot_token_and_date(spark):
    names = ["raw_bgg_data_20240105.parquet", "game_data_20231231.parquet", "x_latest.parquet",
             "a_b_2024013.parquet", "weird.parquet", "z_20240230.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["d"] for r in df.select("name", SN.snapshot_date(F.col("name")).alias("d")).collect()}
    assert got["raw_bgg_data_20240105.parquet"] == dt.date(2024, 1, 5)
    assert got["game_data_20231231.parquet"] == dt.date(2023, 12, 31)
    assert got["x_latest.parquet"] is None and got["a_b_2024013.parquet"] is None
    assert got["weird.parquet"] is None and got["z_20240230.parquet"] is None


def test_latest_and_staleness(spark, tmp_path):
    root = str(tmp_path / "snaps")
    df = spark.createDataFrame([(1,)], "a int")
    for d in ["20240101", "20240110", "undated"]:
        SN.write_snapshot(df.withColumn("d", F.lit(d)), root, "items", d)
    assert SN.read_latest(spark, root).first()["d"] == "20240110"
    as_of = F.to_date(F.lit("2024-01-17"))           # 7 days after the newest: not stale (strict >)
    st = {r["name"]: r["stale"] for r in SN.staleness(spark, root, as_of).collect()}
    assert st == {"items_20240101.parquet": True, "items_20240110.parquet": False, "items_undated.parquet": False}


def test_feedback_parse_optional_fields(spark):
    js = ['{"timestamp":"2024-05-01T10:00:00.000Z","input_game":"A","recommended_game":"B","feedback":"like"}',
          '{"timestamp":"2024-05-01T10:00:01.000Z","input_game":"A","recommended_game":"C","feedback":"dislike",'
          '"reason":"Too complex","comment":"meh"}',
          '{"input_game":"A"}']
    rows = FB.feedback_frame(spark.createDataFrame([(j,) for j in js], "value string")).collect()
    assert len(rows) == 2
    assert rows[0]["reason"] is None and rows[0]["comment"] is None
    assert rows[1]["reason"] == "Too complex" and rows[0]["event_time"] is not None


def test_first_max_label_rules(spark):
    schema = "p array<struct<label:string,votes:bigint>>"
    cases = [([("1", 5), ("2", 9), ("3", 9)], "2"), ([("1", 0), ("2", 0)], None), ([], None),
             ([("x", 3)], "x")]
    df = spark.createDataFrame([(c,) for c, _ in cases], schema)
    got = [r[0] for r in df.select(N.first_max_label(F.col("p"))).collect()]
    assert got == [w for _, w in cases]


def test_ranks(spark):
    schema = "r array<struct<_type:string,_name:string,_value:string>>"
    ranks = [("subtype", "boardgame", "Not Ranked"), ("family", "strategygames", "12"),
             ("family", "familygames", "Not Ranked"), ("family", "thematic", "3")]
    df = spark.createDataFrame([(ranks,), ([],)], schema)
    fr = N.family_rank_columns(F.col("r"))
    out = df.select(N.overall_rank(F.col("r")).alias("g"), *[c.alias(f"c{i}") for i, c in enumerate(fr)]).collect()
    assert tuple(out[0]) == (None, "strategygames", 12, "familygames", None)
    assert tuple(out[1]) == (None, None, None, None, None)


def test_stream_ingest_resumes_and_isolates_corrupt_lines(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.streaming import ingest as ST

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    landing, sink, ckpt = (str(tmp_path / n) for n in ("land", "sink", "ckpt"))
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.json(landing + "/d1")
    ST.ingest_stream(spark, landing + "/*", sink, ckpt, schema=schema)
    (tmp_path / "land" / "d2").mkdir()
    (tmp_path / "land" / "d2" / "part.json").write_text('{"event_id": 3, "event_type": "c"}\n{not json\n')
    ST.ingest_stream(spark, landing + "/*", sink, ckpt, schema=schema)
    out = ST.read_sink(spark, sink).cache()
    assert sorted(r["event_id"] for r in ST.valid_rows(out).collect()) == [1, 2, 3]   # each once
    assert out.filter("_corrupt_record IS NOT NULL").count() == 1


def test_plain_files_presence_and_union(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "plain"
    root.mkdir()
    for d, v in [("20240101", 1), ("20240110", 2)]:
        pq.write_table(pa.table({"k": [1, v], "d": [d, d]}), root / f"x_{d}.parquet")
    spark.createDataFrame([(1, "dataset")], "k long, d string").write.parquet(str(root / "x_20240105.parquet"))
    listed = {r["name"] for r in SN.list_snapshots(spark, str(root)).collect()}
    assert listed == {"x_20240101.parquet", "x_20240105.parquet", "x_20240110.parquet"}
    assert {r["d"] for r in SN.read_latest(spark, str(root)).collect()} == {"20240110"}
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "readme.csv").write_text("a")
    (tmp_path / "empty").mkdir()
    got = {r["stage"]: (r["n_snapshots"], r["is_empty"]) for r in SN.presence(
        spark, {"a": str(root), "b": str(tmp_path / "other"), "c": str(tmp_path / "empty"), "d": str(tmp_path / "none")}).collect()}
    assert got == {"a": (3, False), "b": (1, False), "c": (0, True), "d": (0, True)}
    assert SN.union_snapshots(spark, str(root)).count() == 5
    newest = {r["k"]: r["d"] for r in SN.union_snapshots(spark, str(root), newest_wins=["k"]).collect()}
    assert newest == {1: "20240110", 2: "20240110"}
    path = SN.write_snapshot(spark.range(5), str(root), "x", "20240201", single_file=True)
    assert (root / "x_20240201.parquet").is_file() and SN.read_latest(spark, str(root)).count() == 5 and path


def test_feedback_rejects_csv_and_times(spark, tmp_path):
    rows = ['{bad', '{"timestamp":"t"}', None,
            '{"timestamp":"2024-05-01T10:00:00Z","input_game":"A","recommended_game":"B","feedback":"like","comment":"a\\nb, \\"q\\" \\\\ "}',
            '{"timestamp":"2024-05-01T10:00:00.25+02:00","input_game":"  padded  ","recommended_game":"B","feedback":"like"}']
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    good = FB.feedback_frame(df)
    assert [r["event_time"].isoformat() for r in good.collect()] == ["2024-05-01T10:00:00", "2024-05-01T08:00:00.250000"]
    assert sorted((r["raw"] or "", r["missing"]) for r in FB.feedback_rejects(df).collect()) == [
        ("", "timestamp,input_game,recommended_game,feedback"), ('{"timestamp":"t"}', "input_game,recommended_game,feedback"),
        ("{bad", "timestamp,input_game,recommended_game,feedback")]
    path = str(tmp_path / "log")
    FB.write_csv_log(good, path)
    back = FB.read_csv_log(spark, path).collect()
    assert sorted(r["input_game"] for r in back) == ["  padded  ", "A"]
    assert {r["comment"] for r in back} == {None, 'a\nb, "q" \\ '}


def test_items_of_rooted_responses_and_rejects(spark, tmp_path):
    from tessera.sources import xml_items as X

    (tmp_path / "r.xml").write_text(
        '<?xml version="1.0"?>\n<items>\n  <item type="x" id="1">\n    <name type="primary" value="A"/>\n  </item>\n'
        '  <item id="2"><name value="B"/></item>\n  <item id="3"></item>\n  <item><name value="no id"/></item>\n</items>\n')
    raw = X.read_items(spark, str(tmp_path / "r.xml"))
    assert sorted(r["game_name"] for r in X.extract_items(raw).collect()) == ["A", "B"]
    assert sorted(r["reason"] for r in X.rejected_items(raw).collect()) == ["no id", "no name"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text('<item id="1"><name value="A"/></item>\n\n<item id="2">\n')
    lines = X.read_item_lines(spark, str(tmp_path / "lines"))
    assert [r["game_name"] for r in X.extract_items(lines).collect()] == ["A"]
    plan = X.extract_items(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") <= 1 and X.rejected_items(lines).count() == 1


def test_model_store_publishes_last(spark, tmp_path):
    import pytest

    from tessera.operators import constrained as CO

    path = str(tmp_path / "model")
    assert not CO.model_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        CO.load_model(spark, path)
    one = spark.createDataFrame([(1, "a")], "cluster_id int, name string")
    CO.save_model(one, one, path)
    torn = str(tmp_path / "model" / "versions" / "99999999T-torn")
    one.write.parquet(torn + "/members")          # a crash before the marker
    CO.save_model(one.unionByName(one), one, path)
    assert CO.load_model(spark, path)[0].count() == 2


def test_one_large_response_is_split(spark, tmp_path):
    """A single file is read by many tasks, with the rows of the XML data source."""
    import random

    from tessera.sources import xml_items as X

    rnd = random.Random(1)
    item = lambda i: (f'<item type="boardgame"\n  id="{i}" note="a > b">\n <name type="primary" value="N {i} é &amp; co"/>\n'  # noqa: E731
                      f' <description>{"lorem " * rnd.randrange(0, 60)}</description>\n <link type="boardgamecategory" value="C{i % 3}"/></item>')
    body = ['<?xml version="1.0" encoding="utf-8"?>\n<items termsofuse="x">', *(item(i) for i in range(4000)),
            '<item id="9001"/>', "<item type='single' id='9002'><name type='primary' value='q'/></item>", "<itemised/>", "</items>"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "response.xml").write_text("\n".join(body), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        raw = X.read_items(spark, str(tmp_path / "one"))
        assert raw.rdd.getNumPartitions() > 8
        got, whole = X.extract_items(raw), X.extract_items(X.read_items_whole(spark, str(tmp_path / "one")))
        assert got.count() == 4001
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
        assert [r["reason"] for r in X.rejected_items(raw).collect()] == ["no name"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cut_off_response_is_rejected(spark, tmp_path):
    from tessera.sources import xml_items as X

    (tmp_path / "cut.xml").write_text('<items><item id="1"><name type="primary" value="a"/></item>\n<item id="2"><name type="primary" va', encoding="utf-8")
    raw = X.read_items(spark, str(tmp_path / "cut.xml"))
    assert [r.game_name for r in X.extract_items(raw).collect()] == ["a"]
    assert [r.reason for r in X.rejected_items(raw).collect()] == ["malformed"]


def test_scan_lands_bounded_compressed_responses(spark, tmp_path, monkeypatch):
    """text of the items is neither shuffled nor kept uncompressed; responses grow in number, not in size."""
    import datetime
    import gzip
    from xml.etree import ElementTree

    from tessera.plans import nested_queries as Q

    sf, path = str(tmp_path / "sf"), str(tmp_path / "landed")
    line = lambda k, n: (k, 10 + n, 20 + n, n, 5.0 + n, 0.05, 0.02, "ANR"[n % 3], "OF"[n % 2])
    lines = [line(k * 32, n) for k in range(400) for n in range(1, 1 + k % 5)] + [line(None, 1)] + [line(-7, 1), line(-7, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{sf}/lineitem.parquet")
    day = datetime.datetime(1997, 5, 1)
    orders = [(k * 32, day, 1000.5 + k) for k in range(400)] + [(None, day, 1.0), (-7, day, 2.0), (64, day, 3.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp, o_totalprice double").write.parquet(f"{sf}/orders.parquet")
    ids = sorted([k * 32 for k in range(400) if k % 5] + [-7, 64])    # order 64 comes twice

    monkeypatch.setattr(Q, "shared_path", lambda *_: path)
    monkeypatch.setattr(Q, "LINES_PER_FILE", 50, raising=False)
    rows = Q.xml_items_scan(spark, sf).collect()
    assert sorted(int(r["game_name"].split()[1]) for r in rows) == ids
    assert [r["min_players"] for r in rows if r["game_name"] == "Order -7"] == [3]
    files = sorted((tmp_path / "landed").glob("part-*"))
    roots = [ElementTree.fromstring(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) == 17 and all(r.tag == "items" for r in roots)  # 803 lines, 50 a response
    assert sorted(int(i.get("id")) for r in roots for i in r) == ids
    assert max(len(r) for r in roots) < 60                            # keys in steps of 32 spread too
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

    plan = Q.response_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "item id" in plan and "item id" not in plan[plan.index("Exchange "):]
