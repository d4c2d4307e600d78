"""The driver's entry with and without the training-data operators and what they need."""

import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {absent!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names, set(e.oracle_sql()) - names
print(len(names), any(n.startswith("op1_") for n in names))
"""


def run(*absent):
    return subprocess.run([sys.executable, "-c", CODE.format(absent=absent)], cwd=ROOT, capture_output=True, text=True)


def test_entry_imports_without_what_may_be_absent():
    whole = run("nothing").stdout.split()
    for absent in ("marlpit.llm", "corpus_pipeline", "public_tokenizers"):
        found = run(absent).stdout.split()
        assert found and found[1] == "False" and int(found[0]) <= int(whole[0])


def test_entry_hides_no_error():
    assert "No module named 'marlpit.operators.crm'" in run("marlpit.operators.crm").stderr
