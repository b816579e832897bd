"""The driver's contract, with the subpackage for training corpora and without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "vintagelake.llm" or name.startswith("vintagelake.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = list(e.queries())
assert len(names) > 150 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
print("ok")
"""
    assert run(code).strip() == "ok"


def test_without_a_dependency_of_the_corpus_subpackage():
    code = """
import sys, warnings
warnings.simplefilter("ignore")
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 150 and not any(n.startswith("op") for n in e.queries())
print("ok")
"""
    assert run(code).strip() == "ok"


def test_nothing_else_imports_the_subpackage():
    for f in [*(ROOT / "vintagelake").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(ROOT).parts and f.name != "test_entry.py":
            assert "vintagelake.llm" not in f.read_text(), f


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
