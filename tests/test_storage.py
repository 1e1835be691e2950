"""The shared folder with and without a setting, in processes of their own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from scorenet.storage import dropped, is_local, shared_dir, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false"){more}.getOrCreate()
assert (spark.conf.get("spark.checkpoint.dir", None) is not None) is {named}
t = written(spark.range(5), "t")
assert t.count() == 5 and shared_dir(spark) == shared_dir(spark) and t._scorenet_path.startswith({start!r})
assert spark.range(3).checkpoint().count() == 3
dropped(t)
assert is_local("local[8]") and not is_local("local-cluster[1,1,1024]") and not is_local("yarn")
print("done")
"""


@pytest.mark.parametrize("named", [False, True])
def test_shared_folder(tmp_path, named):
    conf = tmp_path / "conf"
    conf.mkdir()  # no defaults
    folder = f"file://{tmp_path}/shared"
    more = f'.config("spark.checkpoint.dir", {folder!r})' if named else ""
    code = RUN.format(root=ROOT, more=more, named=named, start=folder if named else "file:///")
    got = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(conf)}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0 and "done" in got.stdout, got.stderr[-3000:]
