import os
import subprocess
import sys

from pyspark import cloudpickle

from surgelight.sources.queue import QueueSource

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from surgelight.session import build_session
from surgelight.operators.quotient import repeated_deliveries
spark = build_session("ship", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.checkpoint.dir": sys.argv[1]}})
print("ROWS", [r.seq for r in repeated_deliveries(spark.createDataFrame([("1", 1), ("1", 2)], "id_str string, seq bigint")).collect()])
"""


def test_workers_elsewhere_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS [2]" in run.stdout, run.stderr[-2000:]


def test_the_queue_source_travels_without_the_package(tmp_path):
    """As in the process that plans a Python source: the class arrives whole, the package is not there."""
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a").write_text("=one\n=two\\nlines\n")
    options = {"path": str(tmp_path / "q"), "client": "surgelight.sources.queue:LogClient"}
    (tmp_path / "source").write_bytes(cloudpickle.dumps(QueueSource(options)))
    code = "import sys; from pyspark import cloudpickle; r = cloudpickle.load(open('source', 'rb')).streamReader(None); print(r.latestOffset(), [x for p in r.partitions({'n': 0}, {'n': 2}) for x in r.read(p)])"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True, check=True)
    assert got.stdout.strip().splitlines()[-1] == r"{'n': 2} [(0, 'one'), (1, 'two\nlines')]"
