import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if any(name == g or name.startswith(g + ".") for g in {gone!r}):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, set(entry.oracle_sql()) <= names)
"""


def kept_without(*gone):
    run = subprocess.run([sys.executable, "-c", CODE.format(gone=gone, root=ROOT)], capture_output=True, text=True, check=True)
    n, ops, pipeline, sql = run.stdout.split()
    return int(n) - int(ops) - (pipeline == "True"), sql


def test_other_queries_do_not_need_the_training_data_operators():
    """Without the subpackage, the pipeline, both, or a module that the subpackage needs."""
    found = {kept_without(*gone) for gone in ((), ("gneiss.llm",), ("corpus_pipeline",), ("gneiss.llm", "corpus_pipeline"), ("xxhash",))}
    assert len(found) == 1 and next(iter(found))[0] > 70 and next(iter(found))[1] == "True"
