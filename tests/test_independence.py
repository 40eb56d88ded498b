"""The subpackage for training data may be taken away."""

from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_optional_subpackage():
    for source in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+weftline\.llm", source.read_text(), re.M), source


def test_entry_has_a_callable_for_every_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
