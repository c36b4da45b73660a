"""From 10,000 buildings on, several have the same four digits as their number; the queries still say what their SQL says."""

import duckdb
import pytest
from compare import check

from penumbra import registry


@pytest.mark.parametrize("name", ["building_ids", "campus_directory", "building_details"])
def test_shared_numbers(spark, tmp_path, name, monkeypatch):
    key = "CASE i WHEN 0 THEN 5 WHEN 1 THEN 11 WHEN 2 THEN 1000 ELSE i + 9990 END"
    duckdb.sql(f"COPY (SELECT CAST({key} AS BIGINT) AS s_suppkey, 'Place ' || {key} AS s_name, 0 AS s_nationkey, 1e0 AS s_acctbal FROM range(60) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    monkeypatch.setattr("compare.TABLES", ["supplier"])
    check(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])
