"""Tables between steps go to a folder that all executors see."""

from types import SimpleNamespace

import pytest

from kindred.llm import common


def session(master: str, **conf: str):
    fake = SimpleNamespace(master=master, applicationId="app")
    jsc = SimpleNamespace(hadoopConfiguration=lambda: None)
    return SimpleNamespace(sparkContext=fake, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), _jvm=None, _jsc=jsc)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    monkeypatch.setattr(common.atexit, "register", lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077", spark_sql_warehouse_dir="/w"))
    assert common.shared_dir(session("spark://host:7077", spark_checkpoint_dir="hdfs:///c/")) == "hdfs:///c/app"
    assert common.shared_dir(session("local[2]", spark_sql_warehouse_dir="/w")) == "/w/_kindred/app"
