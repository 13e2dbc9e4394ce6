from types import SimpleNamespace

import pytest

from conftest import rows
from ledgerlake import session


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(
            get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else "/warehouse"
        ),
        sparkContext=SimpleNamespace(master=master, applicationId="app-under-test"),
    )


def test_the_configured_folder_is_used():
    assert session.shared_root(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(fake("local[2]", "/a"), "x").startswith("/a/x-")


def test_without_the_setting_the_warehouse_is_used():
    assert session.shared_root(fake("spark://host:7077")) == "/warehouse/_scratch"


def test_a_default_warehouse_is_refused_on_a_cluster():
    def at(master, warehouse):
        made = fake(master)
        made.conf.get = lambda key, default=None: None if key == "spark.checkpoint.dir" else warehouse
        return made

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(at("yarn", "file:/home/user/spark-warehouse"))
    assert session.shared_root(at("local[2]", "file:/x/spark-warehouse")) == "file:/x/spark-warehouse/_scratch"
    assert session.shared_root(at("yarn", "hdfs://all/spark-warehouse")) == "hdfs://all/spark-warehouse/_scratch"


def test_materialize_cuts_the_plan(spark):
    stored = session.materialize(spark.range(3).selectExpr("id", "id * 2 as twice"), "numbers")
    assert rows(stored) == [(0, 0), (1, 2), (2, 4)]
    assert "FileScan parquet" in stored._jdf.queryExecution().executedPlan().toString()


def test_settings_can_be_overridden(spark):
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
