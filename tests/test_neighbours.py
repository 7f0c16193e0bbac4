from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from weftwork.plans import graph_plans

EDGES = [(20, 1, "R"), (20, 2, "N"), (1, 1, "A"), (2, 2, "R"), (3, 2, "A"), (4, 9, "R"), (40, 7, "N")]


def test_neighbours_over_all_line_items(spark, tmp_path):
    suppliers, orders, flags = zip(*EDGES)
    pq.write_table(pa.table({"l_suppkey": suppliers, "l_orderkey": orders, "l_returnflag": flags}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": sorted(set(suppliers))}), tmp_path / "supplier.parquet")
    found = {tuple(r) for r in graph_plans.gr1_neighbours(spark, str(tmp_path)).collect()}
    assert found == {("S/20", 1, 2, "O/1", "O/2"), ("S/20", 2, 3, "S/1", "S/3"), ("S/40", 1, 1, "O/7", "O/7")}
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert found == set(con.execute(graph_plans.SQL["gr1_neighbours"].replace(" WHERE l_returnflag = 'R'", "")).fetchall())
