"""The corpus operators can be taken out and the rest goes on."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "veilspark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.corpus is None and e.queries() and set(e.oracle_sql()) == set(e.queries())
print("ok", len(e.queries()))
"""


def test_entry_imports_without_them():
    found = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True)
    assert found.stdout.startswith("ok"), found.stderr
