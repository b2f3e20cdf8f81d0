"""Column profiles: of whole tables by typed values, or of a cell table."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text
from ..sources import scratch
from ..sources import tables as S

#: Integers whose sketch promises so many different values, and DENSE of them in each stretch of 32768 numbers, are counted by bitmaps.
MANY, DENSE = 50_000, 64
#: Floating-point columns below this are kept as millionths in a long; others as text.
LARGEST = 1e12


class Fact(NamedTuple):
    """What one pass over a table tells of a column. kind: int, double, time, date or text; route: how its different values are found."""

    col: int
    dataset: str
    column_name: str
    ordinal: int
    native_type: str
    kind: str
    rows: int
    sketched: int | None
    low: int | None
    high: int | None
    route: str


def kind_of(t: T.DataType) -> str:
    kinds = ((T.ByteType, "int"), (T.ShortType, "int"), (T.IntegerType, "int"), (T.LongType, "int"), (T.FloatType, "double"), (T.DoubleType, "double"), (T.TimestampType, "time"), (T.DateType, "date"))
    return next((k for c, k in kinds if type(t) is c), "text")


def code_of(c: Column, kind: str) -> Column:
    """A typed value as a long: two values of a column have one code exactly if they have one text."""
    if kind == "double":
        x = c.cast("double") * 1e6
        # next to a whole number of millionths rounding is beyond doubt; elsewhere it is decimal
        exact = F.abs(x - F.rint(x)) < 1e-3
        return F.when(exact & (F.abs(x) < 1e15), F.rint(x).cast("long")).otherwise((c.cast("decimal(38,6)") * 1_000_000).cast("long"))
    return {"int": lambda: c.cast("long"), "time": lambda: F.unix_micros(c), "date": lambda: F.unix_date(c).cast("long")}[kind]()


def _text(code: Column, kind: Column) -> Column:
    decimal = (code.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,6)").cast("string")
    time = F.date_format(F.timestamp_micros(code), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(kind == "int", code.cast("string")).when(kind == "double", decimal).when(kind == "time", time).when(kind == "date", F.date_from_unix_date(F.when(kind == "date", code).cast("int")).cast("string"))


def measure(tables: dict[str, DataFrame], rename=S.strip_prefix) -> list[Fact]:
    """First phase: one aggregate per table with its rows, the ends of its numeric columns' ranges, and sketches of how many different integers its integer columns hold. As many rows as columns reach the driver."""
    frames, found = [], []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if S.is_atomic(f.dataType)]
        aggs = []
        for i, f in enumerate(fields):
            c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
            ends = (F.min(c).cast("double"), F.max(c).cast("double")) if kind in ("int", "double") else (F.lit(None).cast("double"),) * 2
            whole = (F.min(c).cast("long"), F.max(c).cast("long")) if kind == "int" else (F.lit(None).cast("long"),) * 2
            aggs.append(F.struct(F.lit(i).alias("i"), (F.approx_count_distinct(c) if kind == "int" else F.lit(None).cast("long")).alias("sketched"), ends[0].alias("least"), ends[1].alias("most"), whole[0].alias("low"), whole[1].alias("high")))
        if fields:
            frames.append(df.agg(F.count("*").alias("rows"), F.array(*aggs).alias("a")).select(F.lit(name).alias("dataset"), "rows", F.inline("a")))
            found += [(name, i, f) for i, f in enumerate(fields)]
    seen = {(r.dataset, r.i): r for r in (reduce(DataFrame.unionByName, frames).collect() if frames else [])}
    out = []
    for col, (name, i, f) in enumerate(found):
        r, kind = seen[name, i], kind_of(f.dataType)
        if kind == "double" and r.most is not None and not (abs(r.least) < LARGEST and abs(r.most) < LARGEST):  # also where one is not a number
            kind = "text"
        dense = kind == "int" and r.sketched >= MANY and ((r.high - r.low) // 32768 + 1) * DENSE <= r.sketched
        out.append(Fact(col, name, rename(f.name), i, f.dataType.simpleString(), kind, r.rows, r.sketched, r.low, r.high, "bitmap" if dense else "values"))
    return out


def _columns_of(tables: dict[str, DataFrame], facts: list[Fact], route: str) -> DataFrame | None:
    """col, code, word: the cells of the columns of one route; only these columns are read, and a typed value isn't made a text."""
    frames = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if S.is_atomic(f.dataType)]
        mine = [x for x in facts if x.dataset == name and x.route == route]
        if mine:
            cell = lambda x: F.struct(F.lit(x.col).alias("col"), (F.lit(None).cast("long") if x.kind == "text" else code_of(F.col(f"`{fields[x.ordinal].name}`"), x.kind)).alias("code"), (S.as_text(F.col(f"`{fields[x.ordinal].name}`"), fields[x.ordinal].dataType) if x.kind == "text" else F.lit(None).cast("string")).alias("word"))
            frames.append(df.select(F.inline(F.array(*[cell(x) for x in mine]))))
    return reduce(DataFrame.union, frames) if frames else None


def typed_values(tables: dict[str, DataFrame], facts: list[Fact]) -> DataFrame:
    """col, code, word, n: each different value of the columns that bitmaps don't count, with its rows. One exchange of typed values for all tables."""
    cells = _columns_of(tables, facts, "values")
    return cells.groupBy("col", "code", "word").agg(F.count("*").alias("n"))


def fact_table(spark, facts: list[Fact]) -> DataFrame:
    """The facts as a table: as small as the catalogue."""
    schema = "col int, dataset string, column_name string, ordinal int, native_type string, kind string, rows long, sketched long, low long, high long, route string"
    return spark.createDataFrame([tuple(f) for f in facts], schema)


def texts(values: DataFrame, facts: list[Fact]) -> DataFrame:
    """dataset, column_name, ordinal, native_type, value, n: typed values as text, each made once."""
    named = values.join(F.broadcast(fact_table(values.sparkSession, facts)), "col")
    return named.select("dataset", "column_name", "ordinal", "native_type", F.when(F.col("kind") == "text", F.col("word")).otherwise(_text(F.col("code"), F.col("kind"))).alias("value"), "n")


def profile_and_values(tables: dict[str, DataFrame], samples: int = 5, rename=S.strip_prefix) -> tuple[DataFrame, DataFrame]:
    """(profile, every different value of every column as text with its count) from one exchange: for what looks at values as well."""
    facts = [f._replace(route="values") for f in measure(tables, rename)]
    values = scratch.stored(typed_values(tables, facts), "values")
    return _profile(tables, facts, values, samples), texts(values, facts)


def number_of(c: Column, t: T.DataType) -> Column:
    """The number that a cell's text stands for, without making the text where the type has no need of it."""
    kind = kind_of(t)
    if kind == "double":  # a double's text has six places; below 2**53 millionths their quotient is the double next to it
        rounded = F.when(F.abs(c) < 1e9, code_of(F.when(F.abs(c) < 1e9, c), kind) / F.lit(1e6))
        return F.coalesce(rounded, S.as_text(c, t).try_cast("double"))
    return c.cast("double") if kind == "int" else text.parsed_number(S.as_text(c, t))


def column_types(tables: dict[str, DataFrame], rename=S.strip_prefix) -> DataFrame:
    """dataset, column_name, ordinal, row_count, nulls, null_share, inferred_type: the part of a profile that quality rules and key discovery ask for.

    One aggregate per table and no exchange of values: numbers and dates are known by their type, only texts are parsed, each where it stands. As many rows as columns reach the driver.
    """
    frames, fields = [], {}
    for name, df in tables.items():
        fields[name] = [f for f in df.schema.fields if S.is_atomic(f.dataType)]
        aggs = []
        for i, f in enumerate(fields[name]):
            kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
            if kind == "text":
                v = S.as_text(c, f.dataType)
                blank = v.isNull() | (v == "")
                dates, numbers = (F.coalesce(F.every(F.when(~blank, t)), F.lit(True)) for t in ((F.length(v) >= 8) & text.parsed_date(v).isNotNull(), text.parsed_number(v).isNotNull()))
            else:
                blank, dates, numbers = c.isNull(), F.lit(kind in ("time", "date")), F.lit(kind in ("int", "double"))
            aggs.append(F.struct(F.lit(i).alias("i"), F.count_if(blank).alias("nulls"), dates.alias("dates"), numbers.alias("numbers")))
        if aggs:
            frames.append(df.agg(F.count("*").alias("rows"), F.array(*aggs).alias("a")).select(F.lit(name).alias("dataset"), "rows", F.inline("a")))
    out = []
    for r in reduce(DataFrame.unionByName, frames).collect() if frames else []:
        kind = "unknown" if r.nulls == r.rows else "date" if r.dates else "number" if r.numbers else "string"
        if r.rows:
            out.append((r.dataset, rename(fields[r.dataset][r.i].name), r.i, r.rows, r.nulls, r.nulls / r.rows, kind))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(out, "dataset string, column_name string, ordinal int, row_count long, nulls long, null_share double, inferred_type string")


def value_counts(tables: dict[str, DataFrame], wanted: set[tuple[str, str]], rename=S.strip_prefix) -> DataFrame:
    """dataset, column_name, value, n: each different value of the wanted (dataset, column_name) with its rows. Only these columns are read."""
    frames = []
    for name, df in tables.items():
        mine = [f"`{f.name}`" for f in df.schema.fields if (name, rename(f.name)) in wanted]
        if mine:
            frames.append(S.cells(df.select(*mine), name, rename=rename).groupBy("dataset", "column_name", "value").agg(F.count("*").alias("n")))
    spark = next(iter(tables.values())).sparkSession
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "dataset string, column_name string, value string, n long")


def _order(code: Column, kind: Column) -> tuple[list[Column], Column]:
    """(what parts codes, what orders them): inside a part, texts order as codes do. Numbers are parted by sign and length."""
    size = F.abs(code)
    digits = sum((F.when(size >= 10**k, 1).otherwise(0) for k in range(1, 19)), F.lit(1))
    # a fraction has six places, so its whole part is one digit at least; instants all have one length
    digits = F.when(kind == "double", F.greatest(digits, F.lit(7))).when(kind == "int", digits).otherwise(0)
    return [code < 0, digits], F.when(kind.isin("int", "double"), size).otherwise(code)


def _first_codes(values: DataFrame, samples: int) -> DataFrame:
    """col, kind, code: the different codes that can be among the first texts of their column."""
    parts, order = _order(F.col("code"), F.col("kind"))
    w = Window.partitionBy("col", *parts).orderBy(order)
    return values.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= samples).select("col", "kind", "code")


def _first_bits(maps: DataFrame, samples: int) -> DataFrame:
    """col, kind, code: the same from bitmaps (col, stretch, bits). Of each sign and length only the first stretches are unpacked: those after the first hold a number each."""
    sized = maps.filter("filled > 0").withColumn("low", F.when(F.col("stretch") > 0, (F.col("stretch") - 1) * 32768 + 1).otherwise(-F.col("stretch") * 32768))
    lengths = F.filter(F.sequence(F.lit(1), F.lit(19)), lambda k: (F.length(F.col("low").cast("string")) <= k) & (F.length((F.col("low") + 32767).cast("string")) >= k))
    each = sized.withColumn("digits", F.explode(lengths))
    w = Window.partitionBy("col", F.col("stretch") > 0, "digits").orderBy("low")
    few = each.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= samples + 1).select("col", "stretch", "bits").distinct()

    def unpack(frames):
        for pdf in frames:
            for col, stretch, bits in pdf.itertuples(index=False):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.int64)
                code = (stretch - 1) * 32768 + at + 1 if stretch > 0 else stretch * 32768 - at
                yield pd.DataFrame({"col": col, "kind": "int", "code": code})

    return _first_codes(few.mapInPandas(unpack, "col int, kind string, code long"), samples)


def profile_tables(tables: dict[str, DataFrame], samples: int = 5, rename=S.strip_prefix) -> DataFrame:
    """The profile of profile_columns from whole tables, in two phases.

    A sketch per column (measure) tells which integers can be counted by bitmaps: those are grouped by stretches of 32768 numbers, a bit per number, and never by
    value. All other columns meet in one exchange of typed values; what is parsed as date or number are the different texts of text columns.
    """
    facts = measure(tables, rename)
    values = scratch.stored(typed_values(tables, facts), "values") if any(f.route == "values" for f in facts) else None
    return _profile(tables, facts, values, samples)


def _profile(tables: dict[str, DataFrame], facts: list[Fact], values: DataFrame | None, samples: int) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    named = F.broadcast(fact_table(spark, facts))
    parts, first = [], []
    if values is not None:
        values = values.join(named.select("col", "kind"), "col")
        v = F.col("word")
        blank = F.when(F.col("kind") == "text", v.isNull() | (v == "")).otherwise(F.col("code").isNull())
        typed = F.col("kind") != "text"
        is_date = F.when(typed, F.col("kind").isin("time", "date")).otherwise(text.parsed_date(v).isNotNull() & (F.length(v) >= 8))
        is_number = F.when(typed, F.col("kind").isin("int", "double")).otherwise(text.parsed_number(v).isNotNull())
        parts.append(
            values.groupBy("col").agg(
                F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("nulls"),
                F.count("*").alias("distinct_count"),
                F.count_if(~blank).alias("filled"),
                F.every(blank | is_date).alias("dates"),
                F.every(blank | is_number).alias("numbers"),
            )
        )
        some = values.filter(~blank)
        words = some.filter("kind = 'text'").select("col", F.col("word").alias("value"))
        first += [words.withColumn("_at", F.row_number().over(Window.partitionBy("col").orderBy("value"))).filter(F.col("_at") <= samples).drop("_at"), _first_codes(some.filter(typed), samples).select("col", _text(F.col("code"), F.col("kind")).alias("value"))]
    dense = _columns_of(tables, facts, "bitmap")
    if dense is not None:
        maps = scratch.stored(dense.groupBy("col", F.bitmap_bucket_number("code").alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"), F.count("code").alias("filled"), F.count_if(F.col("code").isNull()).alias("nulls")), "bitmaps")
        # where the number is null there is no bit
        counted = maps.groupBy("col").agg(F.sum("nulls").alias("nulls"), F.sum(F.when(F.col("filled") > 0, F.bitmap_count("bits")).otherwise(0)).alias("bits"), F.sum("filled").alias("filled"))
        parts.append(counted.select("col", "nulls", (F.col("bits") + F.when(F.col("nulls") > 0, 1).otherwise(0)).alias("distinct_count"), "filled", F.lit(False).alias("dates"), F.lit(True).alias("numbers")))
        first.append(_first_bits(maps, samples).select("col", F.col("code").cast("string").alias("value")))
    stats = reduce(DataFrame.unionByName, parts)
    ranked = reduce(DataFrame.unionByName, first).withColumn("_at", F.row_number().over(Window.partitionBy("col").orderBy("value"))).filter(F.col("_at") <= samples)
    ranked = ranked.groupBy("col").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    kind = F.when(F.col("filled") == 0, "unknown").when(F.col("dates"), "date").when(F.col("numbers"), "number").otherwise("string")
    out = stats.join(ranked, "col", "left").join(named, "col").withColumn("inferred_type", kind)
    return out.select(
        "dataset", "column_name", "ordinal", F.col("rows").alias("row_count"), "nulls", (F.col("nulls") / F.col("rows")).alias("null_share"), "distinct_count", "inferred_type",
        ((F.col("distinct_count") == F.col("rows")) & (F.col("rows") > 0)).alias("is_key"), "samples",
    )


def distinct_values(cells: DataFrame) -> DataFrame:
    """dataset, column_name, ordinal, value, native_type, n: each different value once. Everything else profiles these, not the rows."""
    return cells.groupBy("dataset", "column_name", "ordinal", "native_type", "value").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))


def profile_columns(cells: DataFrame, samples: int = 5) -> DataFrame:
    """Null share, distinct count (null is one value), inferred type, key candidate, and the first samples by value."""
    values = distinct_values(cells)
    v = F.col("value")
    empty = v.isNull() | (v == "")
    is_date = F.when(~empty, text.parsed_date(v).isNotNull() & (F.length(v) >= 8))
    is_number = F.when(~empty, text.parsed_number(v).isNotNull())
    stats = values.groupBy("dataset", "column_name", "ordinal").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("nulls"),
        F.count("*").alias("distinct_count"),
        F.every(F.coalesce(is_date, F.lit(True))).alias("dates"),
        F.every(F.coalesce(is_number, F.lit(True))).alias("numbers"),
        F.count_if(~empty).alias("filled"),
    )
    first = values.filter(~empty).withColumn("at", F.row_number().over(Window.partitionBy("dataset", "column_name").orderBy("value"))).filter(F.col("at") <= samples)
    first = first.groupBy("dataset", "column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    kind = F.when(F.col("filled") == 0, "unknown").when(F.col("dates"), "date").when(F.col("numbers"), "number").otherwise("string")
    out = stats.withColumn("inferred_type", kind).withColumn("null_share", F.col("nulls") / F.col("row_count"))
    out = out.withColumn("is_key", (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0))
    return out.join(first, ["dataset", "column_name"], "left").select("dataset", "column_name", "ordinal", "row_count", "nulls", "null_share", "distinct_count", "inferred_type", "is_key", "samples")


def row_counts(cells: DataFrame) -> DataFrame:
    return cells.filter("ordinal = 0").groupBy("dataset").agg(F.count("*").alias("row_count"))


def classify_source(columns: DataFrame, keywords: dict[str, tuple[str, ...]] = rules.SOURCE_KEYWORDS) -> DataFrame:
    """dataset, source_type, confidence: the source with most keywords in the headers; ties go to the first in order."""
    spark = columns.sparkSession
    table = spark.createDataFrame([(i, s, k) for i, (s, ks) in enumerate(keywords.items()) for k in ks], "pref int, source_type string, keyword string")
    header = F.regexp_replace(F.lower("column_name"), " ", "_")
    hits = columns.select("dataset", header.alias("header")).distinct().join(F.broadcast(table), F.col("header").contains(F.col("keyword")))
    scores = hits.groupBy("dataset", "pref", "source_type").agg(F.count_distinct("keyword").alias("score"))
    best = scores.groupBy("dataset").agg(F.max(F.struct("score", (-F.col("pref")).alias("pref"), "source_type")).alias("b"))
    every = columns.select("dataset").distinct().join(best, "dataset", "left")
    conf = F.when(F.col("b").isNull(), 0.2).otherwise(F.least(0.5 + 0.15 * F.col("b.score"), F.lit(0.95)))
    return every.select("dataset", F.coalesce("b.source_type", F.lit("Unknown")).alias("source_type"), conf.alias("confidence"))


def apply_source_verdicts(classified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """An outside label and confidence replace the heuristic; a verdict without a label means it failed: confidence times 0.8."""
    both = classified.join(verdicts.select("dataset", F.col("source_type").alias("v_type"), F.col("confidence").alias("v_conf"), F.lit(True).alias("asked")), "dataset", "left")
    conf = F.when(F.col("v_type").isNotNull(), F.coalesce("v_conf", "confidence")).when(F.col("asked"), F.col("confidence") * 0.8).otherwise(F.col("confidence"))
    return both.select("dataset", F.coalesce("v_type", "source_type").alias("source_type"), conf.alias("confidence"))
