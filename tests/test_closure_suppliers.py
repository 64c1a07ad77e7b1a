"""The graph's closure down to the suppliers of the parts reached."""

from tidemark.plans import records


def test_closure_reaches_suppliers(spark, tmp_path):
    for name, rows, schema in (
        ("customer", [(1, 3), (2, 4)], "c_custkey bigint, c_nationkey int"),
        ("orders", [(10, 1), (11, 2)], "o_orderkey bigint, o_custkey bigint"),
        ("lineitem", [(10, 100, 7), (10, 100, 7), (11, 100, 8), (11, 101, 9)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["node"]: r["depth"] for r in records.graph_closure(spark, str(tmp_path)).collect()}
    assert got == {"n3": 0, "c1": 1, "o10": 2, "p100": 3, "s7": 4, "s8": 4}
