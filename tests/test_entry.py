"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e


def test_entry_has_rows(spark):
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["l_returnflag", "l_linestatus", "sum_qty", "n", "low"]


def test_every_oracle_has_a_query():
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert all(callable(f) for f in names.values())
    core = [n for n in names if not n.startswith("op") and n != "pipeline"]
    assert set(core) <= set(e.oracle_sql())


def test_core_queries_without_the_libraries_of_text_preparation():
    code = (
        "import sys\n"
        "for name in ('ahocorasick', 'zstandard', 'public_tokenizers'):\n"
        "    sys.modules[name] = None\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert len(names) >= 91 and set(e.oracle_sql()) <= set(names)\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(e.__file__).parent)
