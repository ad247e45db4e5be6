"""The package reaches the workers wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from streampace.session import get_session, load
from streampace.operators import control, series
spark = get_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rates = series.rate_series(load(spark, "/root/testdata/sf0.001", "events"), ["event_type"])
print("rows", control.smooth_intervals(control.with_interval(rates, "rate"), size=64).count())
"""


def test_fold_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
