import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None  # importing it fails
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), sorted(set(entry.queries()) & {{"label_run", "pipeline"}}))
assert set(entry.oracle_sql()) <= set(entry.queries())
"""


@pytest.mark.parametrize("names", [["rowloom.llm", "corpus_pipeline"], ["ahocorasick"], ["xxhash", "sentencepiece"], ["corpus_pipeline"]])
def test_entry_without_a_library_or_the_pipeline(names):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names, root=ROOT)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "['label_run']" in done.stdout and int(done.stdout.split()[0]) >= 80
