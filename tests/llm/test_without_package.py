"""Executors need no copy of the package: queries run where workers cannot import it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from depotlens.session import build_session
spark = build_session("apart", "local[4]", {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
spark.sparkContext.setLogLevel("ERROR")
for name, query in entry.queries().items():
    if name.startswith({prefixes!r}):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


@pytest.mark.parametrize("prefixes", [("op1_", "op2_", "op3_", "op4_", "op6_", "op7_", "op8_"),
                                      ("op5_", "op9_", "op10_", "op11_", "op12_", "op13_", "pipeline")])
def test_queries_run_where_workers_lack_the_package(tmp_path, prefixes):
    # workers start in a folder without the package, and no variable leads to it
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO, prefixes=prefixes)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    ran = [line for line in done.stdout.splitlines() if line.startswith("ran")]
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(ran) >= len(prefixes)
