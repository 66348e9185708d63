"""The driver contract holds without the text subpackage too."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "l3_build_causality" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_text_operators():
    for name in ("corpus_pipeline", "causalspark.llm"):
        done = subprocess.run([sys.executable, "-c", WITHOUT.format(name=name)], cwd=ROOT, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
