"""The entry module with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_without_llm():
    out = run("import sys; sys.modules['tidegate.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))")
    n, m, some = out.split()
    assert int(n) > 40 and int(m) >= int(n) - 2 and some == "False"


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
