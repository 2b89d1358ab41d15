"""Runtime settings and the shared folder."""

from types import SimpleNamespace

import pytest

from freshet import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def stub(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    spark = stub("yarn", **{"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    assert session.shared_folder(spark) == "hdfs://shared/checkpoints"
    assert session.fresh_path(spark, "a").startswith("hdfs://shared/checkpoints/a-")
    assert session.fresh_path(spark, "a") != session.fresh_path(spark, "a")


def test_a_cluster_needs_a_named_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(stub(master))


def test_one_process_may_use_its_own_folder():
    assert session.shared_folder(stub("local[2]")) == session.shared_folder(stub("local"))


def test_prepare_pins_the_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        session.prepare(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_staged_rows_keep_their_types(spark):
    rows = spark.range(5).selectExpr("id", "cast(id as string) as t", "array(struct(id as x)) as a")
    kept = session.staged(rows, "rows")
    assert kept.dtypes == rows.dtypes and sorted(kept.collect()) == sorted(rows.collect())
