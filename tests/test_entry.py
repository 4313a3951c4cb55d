"""The contract, with and without the training-data part."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "distance", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stands_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "tarnwell"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tarnwell/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2_top10' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
