import ast
import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["query_id", "chunk_id", "score", "rank"]


def test_registry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    names = entry.queries()
    assert "bm25_topk" in names and not any(re.match(r"op\d+_|pipeline", n) for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    for path in [*ROOT.glob("sparkloom/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path
