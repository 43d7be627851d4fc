"""The shared folder, and helpers of tasks."""

from types import SimpleNamespace

import numpy as np
import pytest

from odweave.llm import common


def session(spark, folder, **context):
    """The session with another shared folder; the setting can't be changed in one that runs."""
    context = {"master": "local[4]", "applicationId": spark.sparkContext.applicationId} | context
    conf = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else spark.conf.get(name, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(**context), _jvm=spark._jvm, _jsc=spark._jsc)


def test_shared_folder(spark, tmp_path):
    own = session(spark, str(tmp_path))  # no scheme: Spark's default file system
    path = common.scratch(own, "x")
    assert path.startswith(f"file:{tmp_path}/x-")
    fs, place = common.file_system(path)
    fs.create_dir(place)
    assert (tmp_path / path.rsplit("/", 1)[1]).is_dir()
    common.remove(spark, path)
    assert not list(tmp_path.glob("*"))
    assert common.scratch(session(spark, "hdfs://there/a/"), "x").startswith("hdfs://there/a/x-")
    with pytest.raises(ValueError, match="file system"):
        common.file_system("/somewhere")


def test_written_tables_go_when_discarded(spark):
    table = common.written(spark.range(3), "rows")
    fs, place = common.file_system(table.written_to)
    assert table.count() == 3 and fs.get_file_info(place).is_file is False
    common.discard(table)
    assert fs.get_file_info(place).type.name == "NotFound"


def test_no_shared_folder(spark):
    """In local mode one of this machine serves an application; a cluster raises."""
    first, second = (common.scratch(session(spark, None), "x").rsplit("/", 1)[0] for _ in range(2))
    assert first == second and first.startswith("file:///")
    with pytest.raises(ValueError, match="share"):
        common.scratch(session(spark, None, master="spark://host:7077"), "x")


def test_stretches():
    assert list(common.stretches(np.array([], np.int64))) == []
    assert list(common.stretches(np.array([4, 4, 9]))) == [(4, 0, 2), (9, 2, 3)]
