"""Relations as Spark reads them, beside the same text in DuckDB."""

import duckdb
import pandas as pd

from lantern.plans import base, graphs  # noqa: F401


def test_error_rates_that_differ_in_the_sixth_digit(spark, tmp_path):
    """Averages of 0 and 1 over many orders, nearer to each other than 1e-5: none is rounded to the other."""
    n, failed = 240_000, {0: 80_000, 1: 79_999, 2: 80_010}
    tables = {
        "region": pd.DataFrame({"r_regionkey": [0]}),
        "nation": pd.DataFrame({"n_nationkey": [0, 1, 2], "n_regionkey": [0, 0, 0]}),
        "customer": pd.DataFrame({"c_custkey": [0, 1, 2], "c_nationkey": [0, 1, 2]}),
        "orders": pd.DataFrame({"o_custkey": [k for k in failed for _ in range(n)], "o_totalprice": 1000.0, "o_orderstatus": [s for f in failed.values() for s in "F" * f + "O" * (n - f)]}),
    }
    own = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(tmp_path / f"{name}.parquet")
        own.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = {(a, b) for a, b, *_ in own.execute(base.SQL["m05_error_edges"]).fetchall()}
    found = {(r["source"], r["target"]) for r in base.QUERIES["m05_error_edges"](spark, str(tmp_path)).collect()}
    assert found == want and len(want) == 3


def test_quoted_numbers_stay_as_they_are():
    assert base._with_doubles("select '1.5', 0.25, x.y1, 2.5e0, 3") == "select '1.5', 0.25D, x.y1, 2.5e0, 3"
