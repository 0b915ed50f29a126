"""The driver contract without the optional packages."""

import subprocess
import sys

import pytest

CORE = 58
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {gone!r}:
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(len([n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]))
"""


@pytest.mark.parametrize("gone", [["regex"], ["tokenizers"], ["zstandard"], ["tiktoken", "public_tokenizers"]])
def test_core_queries_without_optional_packages(gone):
    done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == str(CORE), done.stderr
