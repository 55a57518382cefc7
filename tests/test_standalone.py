"""The core works without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['docweave.llm'] = None; import __spark_entry__ as e; names = set(e.queries()); assert e.llm is None and 'p6_found' in names and 'p1_found' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    others = [p for p in (ROOT / "docweave").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert [str(p) for p in others if "docweave.llm" in p.read_text() and p.name != "__init__.py"] == []
