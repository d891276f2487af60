"""Every registered query against its SQL twin on a small table, where the tables are at hand."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in entry.catalog.QUERIES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_optional_parts_are_missed_only_where_their_files_are_gone(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "leftover" / "__pycache__").mkdir(parents=True)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "__init__.py").write_text("")
    (tmp_path / "broken" / "part.py").write_text("import no_such_module_anywhere")
    assert entry._if_there("nowhere_at_all", "nowhere_at_all") is None and entry._if_there("leftover", "leftover.part") is None
    with pytest.raises(ImportError):
        entry._if_there("broken", "broken.part")
