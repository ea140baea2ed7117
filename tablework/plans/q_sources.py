"""Source, sink and user-function queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablework.functions.text import clean_file_name
from tablework.operators import aggregate as A
from tablework.operators.udf import GroupAggregate, apply_in_pandas, map_batches
from tablework.plans.common import rounded, table
from tablework.session import join_small, shared_path
from tablework.sources import files as S
from tablework.sources.scan import read_csv, read_source, table_path

LONG_NAME = "concat(url, '/', repeat('a', CAST(page_id % 130 AS INT)), '.html')"


def _net_columns(pdf):
    out = pdf[["l_orderkey", "l_linenumber"]].copy()
    out["net"] = pdf["l_extendedprice"] * (1 - pdf["l_discount"])
    out["log_price"] = np.log1p(pdf["l_extendedprice"])
    out["qty_band"] = np.floor(pdf["l_quantity"] / 10).astype("int64")
    return out


def _fold_moments(state, rows):
    value = rows["value"].dropna()
    return _merge_moments(state, (len(value), value.mean(), ((value - value.mean()) ** 2).sum()) if len(value) else (0, 0.0, 0.0))


def _merge_moments(a, b):
    """Count, mean and squared deviations of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


def _finish_moments(state):
    n, mean, squares = state
    return {"v_mean": mean if n else None, "v_std": (squares / (n - 1)) ** 0.5 if n > 1 else None}


MOMENTS = GroupAggregate(lambda: (0, 0.0, 0.0), _fold_moments, _merge_moments, _finish_moments)


def _zscore(pdf):
    out = pdf[["event_id", "event_type"]].copy()
    std = pdf["v_std"].where(pdf["v_std"] != 0)
    out["z"] = (pdf["value"] - pdf["v_mean"]) / std
    return out


def register(reg):
    @reg.add("scan_csv", "SELECT * FROM nation")
    def scan_csv(spark, sf):
        path = shared_path(spark, "csv", "nation.csv")
        table(spark, sf, "nation").write.mode("overwrite").option("header", True).csv(path)
        return read_csv(spark, path)

    @reg.add("scan_parquet", "SELECT * FROM supplier")
    def scan_parquet(spark, sf):
        return read_source(spark, table_path(sf, "supplier"))

    @reg.add("sink_roundtrip", """
        SELECT l_returnflag, round(sum(l_extendedprice), 4) AS sum_l_extendedprice, count(*) AS count_all
        FROM lineitem GROUP BY l_returnflag""")
    def sink_roundtrip(spark, sf):
        res = A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag"], ["sum(l_extendedprice)", "count(*)"])
        path = S.save_result(rounded(res.df), "sum of extended price by return flag")
        return spark.read.parquet(path)

    @reg.add("dataset_catalog")
    def dataset_catalog(spark, sf):
        return S.dataset_catalog(spark, sf)

    @reg.add("clean_names", f"""
        WITH t AS (SELECT page_id, regexp_replace(regexp_extract({LONG_NAME}, '([^/\\\\]*)$', 1), '[^\\w\\-_.]', '_', 'g') AS safe
                   FROM pages),
             e AS (SELECT page_id, safe, regexp_extract(safe, '(\\.[^.]*)$', 1) AS ext FROM t)
        SELECT page_id, CASE WHEN length(safe) > 100 THEN substring(substring(safe, 1, length(safe) - length(ext)), 1, 90) || ext
                             ELSE safe END AS clean_name
        FROM e""")
    def clean_names(spark, sf):
        pages = table(spark, sf, "pages")
        return pages.select("page_id", clean_file_name(F.expr(LONG_NAME)).alias("clean_name"))

    @reg.add("fingerprint_files")
    def fingerprint_files(spark, sf):
        return S.fingerprint_files(spark, sf)

    @reg.add("fingerprint_rows", """
        WITH m AS (SELECT md5(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, 'null'), CAST(round(o_totalprice * 100) AS BIGINT),
                                        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), coalesce(o_orderpriority, 'null'))) AS h FROM orders)
        SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) AS high_sum,
               CAST(sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR) AS low_sum FROM m""")
    def fingerprint_rows(spark, sf):
        orders = table(spark, sf, "orders")
        return S.fingerprint_rows(orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long"),
                                                F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "o_orderpriority"))

    @reg.add("udf_map_in_pandas", """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
               round(ln(1 + l_extendedprice), 4) AS log_price, CAST(floor(l_quantity / 10) AS BIGINT) AS qty_band
        FROM lineitem""")
    def udf_map_in_pandas(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                                 "l_discount", "l_quantity")
        out = map_batches(df, _net_columns,
                          "l_orderkey long, l_linenumber int, net double, log_price double, qty_band long")
        return rounded(out)

    @reg.add("udf_apply_in_pandas", """
        SELECT event_id, event_type,
               round((value - avg(value) OVER (PARTITION BY event_type))
                     / nullif(stddev_samp(value) OVER (PARTITION BY event_type), 0), 4) AS z
        FROM events""")
    def udf_apply_in_pandas(spark, sf):
        ev = table(spark, sf, "events").select("event_id", "event_type", "value")
        stats = apply_in_pandas(ev, ["event_type"], MOMENTS, "v_mean double, v_std double")
        out = map_batches(join_small(ev, stats, ["event_type"], "left"), _zscore, "event_id long, event_type string, z double")
        return rounded(out)
