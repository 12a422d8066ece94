import importlib

import pytest
from against_sql import SF, same

MODULES = ["matrix_queries", "graph_queries", "stats_queries", "model_queries"]
LOADED = {m: importlib.import_module(f"fluxcell.plans.{m}") for m in MODULES}
WITH_SQL = [(m, k) for m, x in LOADED.items() for k in x.QUERIES if k in x.SQL]
WITHOUT = [(m, k) for m, x in LOADED.items() for k in x.QUERIES if k not in x.SQL]


@pytest.mark.parametrize("module,name", WITH_SQL)
def test_matches_sql(spark, module, name):
    x = LOADED[module]
    same(x.QUERIES[name](spark, SF), x.SQL[name])


@pytest.mark.parametrize("module,name", WITHOUT)
def test_runs(spark, module, name):
    df = LOADED[module].QUERIES[name](spark, SF)
    assert df.columns
    df.count()


def test_names_are_unique():
    names = [k for x in LOADED.values() for k in x.QUERIES]
    assert len(names) == len(set(names))
