"""The entry point works with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_corpus_operators():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *_):\n"
        "        if name.startswith('fraudlens.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "fraudlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "fraudlens.llm" not in path.read_text()
