import duckdb
import pytest

import __spark_entry__ as E

CHECK = ["agg_monthly", "filter_and_or", "agg_extrema", "dq_outliers", "chart_corr", "summary_trend",
         "run_checks", "asof_join", "sql_window_frame", "udf_apply_in_pandas"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "sum_o_totalprice", "count_all"]
    assert df.count() > 0


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100


@pytest.mark.parametrize("name", CHECK)
def test_oracle_agreement(spark, sf, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = E.queries()[name](spark, sf).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "None"
        return str(round(v, 4)) if isinstance(v, float) else str(v)

    def norm(df):
        return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))
    assert norm(got) == norm(want)
