"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["channel", "wavelength", "trial_type", "reltime", "value", "n"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lumenframe.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
