"""The entry without the training-data part, or without packages that only it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {0!r} or name.startswith({0!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {1!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert "j13_cohort_fold" in names
print(sum(n.startswith("op") or n == "pipeline" for n in names))
"""


def run(hidden):
    return subprocess.run([sys.executable, "-c", HIDE.format(hidden, ROOT)], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "taskweave.llm", "public_tokenizers"])
def test_the_rest_works_without(hidden):
    done = run(hidden)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"


def test_a_missing_module_of_the_library_is_an_error():
    assert run("taskweave.session").returncode != 0
