import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import functions as F
from millrace.session import cut, local_session, prepared, stored
from millrace.functions.numeric import accuracy
spark = prepared(local_session(2))
df = spark.createDataFrame([("<answer>1,000</answer>", "1000")], "c string, t string")
assert df.select(accuracy(F.col("c"), F.col("t"))).first()[0]
assert stored(cut(df), "x").count() == 1
print("fine")
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_shared_folder_is_taken_from_the_session(spark):
    from millrace.session import cut

    assert cut(spark.range(3)).count() == 3
    assert not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
