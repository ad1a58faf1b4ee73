import os
import subprocess
import sys
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
sys.path.insert(0, {root!r})  # the driver has the package, its workers don't
from stridemill import runtime
from stridemill.operators import nbody
spark = runtime.session("elsewhere", 2, {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print(runtime.ship(spark))
bodies = spark.range(5).selectExpr("id", "id * 0.1 AS x", "0D AS y", "0D AS z", "1e6D AS m")
assert nbody.forces(bodies).count() == 5
runtime.terminate(spark)
runtime.terminate(spark)
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    names = zipfile.ZipFile(done.stdout.split()[-1]).namelist()
    assert "stridemill/runtime.py" in names and all(n.endswith(".py") for n in names)


def test_the_prelude_has_what_it_lists(spark):
    from stridemill import prelude

    got: dict = {}
    exec("from stridemill.prelude import *", got)
    assert set(prelude.__all__) <= set(got) and len(set(prelude.__all__)) == len(prelude.__all__)
    frame = got["IndexedFrame"].from_ordered(spark.createDataFrame([("b",), ("a",)], "v string"), ["v"])
    assert sorted(map(tuple, frame.df.collect())) == [(0, "a"), (1, "b")]
