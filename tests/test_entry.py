import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    rows = e.entry(spark).collect()
    assert {r.col_a for r in rows} == {"l_returnflag", "l_linestatus", "l_linenumber"}


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, *_):
        if name == "corpus_pipeline" or name == "profilark.llm" or name.startswith("profilark.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "marginal_entropy" in e.queries() and "pipeline" not in e.queries() and not any(k.startswith("op1_") for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
