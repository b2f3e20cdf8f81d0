"""Steps that must not grow with what they don't need: types without an exchange of values, outliers without texts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trustloom.functions import text
from trustloom.operators import model as A
from trustloom.operators import profile as P
from trustloom.operators import quality as Q
from trustloom.sources import tables as S


def table(spark):
    draw = random.Random(4)
    words = ["", None, "2024-01-01", "1/2/2024", "2024-01-01 10:00:00", "2024-01-01T10:00:00Z"]
    numbers = [" 12 ", "-1.5e3", "NaN", "+inf", "Infinity", "0x1p3", "7d", None, ""]
    rows = [(i, draw.choice([1.5, 0.1 + 0.2, -2.25, None, 1e-7, 1e300, float("nan")]), draw.choice(words), draw.choice(numbers), draw.choice(["soon", "1-URGENT", "2024-01-01"]), dt.datetime(2024, 1, 1), None, i % 2 == 0) for i in range(300)]
    return spark.createDataFrame(rows, "id long, ratio double, day string, number string, word string, at timestamp, none string, flag boolean")


def test_types_like_the_cell_table(spark):
    tables = {"t": table(spark), "empty": spark.createDataFrame([], "k int, s string")}
    cols = ["dataset", "column_name", "ordinal", "row_count", "nulls", "null_share", "inferred_type"]
    df = P.column_types(tables)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(map(tuple, P.profile_columns(S.all_cells(tables)).select(cols).collect()))


def test_guards_leave_nothing_out(spark):
    words = ["1", " 1", "\t-2.5E-3 ", "1f", "1_0", "", "nan", "-NaN", "+Infinity", "INF", "0x1.8p1", "5-LOW", "1e", ".", "1d ", "2024-01-01", "+12024-01-01", "-0044-03-15", "1/2/2024", "2024/1/2", "x2024-01-01", "2024-01-01 00:00:00.123456"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    layouts = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy", "yyyy/M/d")
    plain = F.coalesce(*[F.try_to_timestamp("w", F.lit(x)) for x in layouts])
    for r in df.select("w", text.parsed_number(F.col("w")).eqNullSafe(F.col("w").try_cast("double")).alias("n"), text.parsed_date(F.col("w")).eqNullSafe(plain).alias("d")).collect():
        assert r.n and r.d, r.w


def test_outliers_of_whole_tables(spark):
    rows = [(float(i % 10), str(i % 10), i % 7) for i in range(500)] + [(1000.0 + i % 7, "1000" if i % 2 else "1000.0", -5000) for i in range(9)] + [(None, None, None)]
    tables = {"t": spark.createDataFrame(rows, "x double, word string, k long"), "few": spark.createDataFrame([(1.0,), (9.0,)], "y double")}
    cells = S.all_cells(tables)
    got, want = Q.column_outliers(tables, P.column_types(tables)), Q.outliers(cells, P.profile_columns(cells))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 3


def test_relationships_sort_nothing(spark):
    """Many edges end at one node: a task that sorts or holds them grows with the input."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.range(500).selectExpr("concat('vendor:', id) from_id", "if(id = 3, 'group:x', 'application:a') to_id", "if(id = 4, 'maps_to_category', 'supplies') edge_type", "cast(null as string) label", "0.5d confidence", "if(id = 5, 'gone', 'part') dataset")
        nodes = spark.range(499).selectExpr("concat('vendor:', id) id", "'v' name", "'vendor' entity_type").union(spark.sql("select 'application:a', 'a', null union all select 'group:x', 'x', 'attribute_group'"))
        out = A.relationships(edges, nodes, spark.sql("select 'part' dataset, 'part.parquet' file_name"))
        assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
        rows = {r.from_id: r for r in out.collect()}
        assert len(rows) == 497 and not {"vendor:3", "vendor:4", "vendor:499"} & set(rows)
        assert rows["vendor:5"].evidence is None and rows["vendor:6"].evidence == "part.parquet" and rows["vendor:6"].to_name == "a" and rows["vendor:6"].relationship == "supplies"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
