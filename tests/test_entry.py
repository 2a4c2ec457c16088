from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["tessera", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
if {gone}:
    sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "WIN01_quartile_digit" in q
print(len(q), sum(k.startswith("op") for k in q), "pipeline" in q)
"""


def run(gone: bool) -> list[str]:
    return subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_llm_subpackage():
    n, ops, pipeline = run(True)
    assert int(n) > 200 and ops == "0" and pipeline == "False"


def test_entry_names_are_stable():
    n, _, _ = run(False)
    assert int(n) > 200
