import importlib.util
import re
import subprocess
import sys

import __spark_entry__ as entry

from .conftest import ROOT


def test_contract(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() >= 0


def test_imports_without_the_subpackage(tmp_path):
    """A copy without it and the pipeline still imports, with the other queries."""
    import shutil

    shutil.copytree(ROOT / "folioscan", tmp_path / "folioscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'search_and' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "folioscan").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
    assert importlib.util.find_spec("folioscan")
