import builtins
import importlib
import subprocess
import sys
from pathlib import Path

import pytest


def test_entry_points_import_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


@pytest.mark.parametrize("missing", ["ahocorasick", "corpus_pipeline", "starloom.llm"])
def test_core_queries_stay_where_a_package_is_missing(monkeypatch, missing):
    import __spark_entry__ as e
    from starloom.plans.registry import ORACLES, QUERIES

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == missing or name.startswith(f"{missing}."):
            raise ImportError(f"no {name}")
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("starloom.llm") or m in ("corpus_pipeline", missing)]:
        monkeypatch.delitem(sys.modules, name)
    package = importlib.import_module("starloom")
    if hasattr(package, "llm"):
        monkeypatch.delattr(package, "llm")
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert "pipeline" not in e.queries()
