"""The query catalogue without the optional training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
# makes one module impossible to import, as if it were not installed
BLOCK = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as E
q, o = E.queries(), E.oracle_sql()
print(len(q), sum(n.startswith("op") for n in q), "pipeline" in q, set(o) <= set(q), "baseline_strict_90d" in q)
"""


@pytest.mark.parametrize("name", ["ahocorasick", "comparo.llm", "corpus_pipeline"])
def test_core_queries_without(name):
    if name == "ahocorasick" and not (REPO / "corpus_pipeline.py").exists():
        pytest.skip("the operators are not there")
    out = subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=REPO, capture_output=True, text=True, timeout=120)
    n, ops, pipeline, known, core = out.stdout.split()[-5:]
    assert int(n) > 90 and ops == "0" and pipeline == "False" and known == core == "True", out.stderr[-500:]


def test_missing_core_module_is_an_error():
    out = subprocess.run([sys.executable, "-c", BLOCK.format(name="comparo.session")], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert "No module named" in out.stderr
