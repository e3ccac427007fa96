"""The session helper obeys the cluster."""

from tessera import session as S


def test_no_master_and_no_sizes_unless_local():
    conf = S.session_conf()
    assert not {"spark.master", "spark.driver.memory", "spark.sql.shuffle.partitions"} & set(conf)
    conf = S.session_conf("spark://host:7077", **{"spark.executor.memory": "9g"})
    assert conf["spark.master"] == "spark://host:7077" and conf["spark.executor.memory"] == "9g"
    assert "spark.sql.shuffle.partitions" not in conf
    assert S.session_conf("local[3]")["spark.sql.shuffle.partitions"] == "8"


def test_session_keeps_its_master_and_sizes(spark):
    master = spark.sparkContext.master
    again = S.get_spark()
    assert again.sparkContext.master == master
    assert again.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_materialise_tells_bytes(spark):
    df, size = S.materialise(spark.range(1000), "test-size")
    assert df.count() == 1000 and 0 < size < 100_000
