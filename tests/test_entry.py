"""The entry module: names, oracles, and agreement of every query with its SQL at the smallest size."""

import pytest

import __spark_entry__
from tamis.plans import catalog

VIEWS = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.FLAGSHIP in __spark_entry__.queries()


def test_missing_parts_are_left_out(monkeypatch):
    real = __spark_entry__.importlib.import_module

    def without(name):
        if name.startswith(("tamis.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name.split(".queries")[0])
        return real(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", without)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError(name="numpy")))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf}/{view}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if sql := catalog.ORACLE_SQL.get(name):
        made = duck.execute(sql)
        columns = [d[0] for d in made.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(map(repr, made.fetchall()))
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == want
