from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from placelens.session import CHECKPOINT_DIR, scratch_path, staged


def session_with(root, master="local[4]"):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda key, default: root if key == CHECKPOINT_DIR else default))


def test_scratch_is_in_the_folder_of_the_cluster():
    path = scratch_path(session_with("hdfs://shared/cp/"), "x")
    assert path.startswith("hdfs://shared/cp/placelens/x-")
    assert path != scratch_path(session_with("hdfs://shared/cp/"), "x")


def test_scratch_without_a_shared_folder_keeps_one_root():
    a, b = (scratch_path(session_with(None), "x") for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError):
        scratch_path(session_with(None, master), "x")


def test_staged_tables_prune_columns(spark):
    df = staged(spark.range(5).withColumn("x", F.lit("y")), "t")
    assert df.count() == 5 and df.columns == ["id", "x"]
    assert "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().executedPlan().toString()
