"""Every registered query that has SQL gives the SQL's rows; the rest run."""

import importlib.util
import sys

import pytest

from spanloom.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, sf, name):
    out = core.queries()[name](spark, sf)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    if name in core.oracle_sql():
        want = duck.sql(core.oracle_sql()[name])
        assert sorted(want.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, duck.sql(f"select {quoted} from ({core.oracle_sql()[name]})").fetchall()))
    else:
        assert rows


def test_entry_without_the_llm_folders(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("spanloom.llm") or name == "corpus_pipeline" else find(name, *a))
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(core.queries()) and set(entry.oracle_sql()) == set(core.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
