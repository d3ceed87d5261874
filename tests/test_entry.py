"""The driver's contract holds with and without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and q; print(*sorted(q))"


def _names(at: Path) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", PROGRAM], cwd=at, capture_output=True, text=True, check=True).stdout.split()


def _copy(to: Path) -> Path:
    shutil.copytree(ROOT / "treequill", to / "treequill", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def test_queries_without_the_llm_folder(tmp_path):
    """With the folder gone, corpus_pipeline.py may still lie there or be gone too."""
    at = _copy(tmp_path)
    alone = _names(at)
    assert "flagship_order_value" in alone and "pipeline" not in alone and not [n for n in alone if n.startswith("op1_")]
    (at / "corpus_pipeline.py").write_text("from treequill.llm import near\n")
    assert _names(at) == alone


def test_every_query_name_is_unique_and_sql_names_a_query():
    names = _names(ROOT)
    assert len(names) == len(set(names))
