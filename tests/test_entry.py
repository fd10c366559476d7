import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "time_overlap" in entry.queries()


def test_smoke(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.k_start for r in rows] == sorted(r.k_start for r in rows)


def test_library_does_not_import_the_optional_package():
    for path in (ROOT / "intervalis").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "intervalis").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
