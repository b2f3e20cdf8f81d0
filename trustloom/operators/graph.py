"""Keys, edges and walks of the entity graph."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import scratch
from ..sources import tables as S
from . import profile as profiles


def column_sets(cells: DataFrame) -> DataFrame:
    """dataset, column_name, value: each different trimmed, non-empty value of a column once."""
    return cells.select("dataset", "column_name", text.trimmed(F.col("value")).alias("value")).filter("value <> ''").distinct()


def key_decision(overlap, uniq_a, uniq_b, name_sim, type_match, min_overlap: float = 0.6, min_uniqueness: float = 0.9):
    """(is_match, pk_is_a, confidence) as columns."""
    pk_is_a = uniq_a >= uniq_b
    uniq = F.when(pk_is_a, uniq_a).otherwise(uniq_b)
    is_match = (name_sim > 0) & (overlap >= min_overlap) & (uniq >= min_uniqueness)
    confidence = F.least(F.lit(0.98), 0.45 * overlap + 0.3 * uniq + 0.15 * name_sim + 0.1 * type_match)
    return is_match, pk_is_a, F.round(confidence, 3)


#: Hashes of a column's sketch.
SKETCH = 1024


def _pairs(tables: dict[str, DataFrame], profile: DataFrame, rename) -> list[dict]:
    """Pairs of columns of different tables with similar names, from the profile alone: as many as the catalogue gives."""
    p = profile.filter("not is_technical").select("dataset", "column_name", "row_count", "inferred_type")
    a, b = (p.select(*[F.col(c).alias(f"{s}_{c}") for c in p.columns]) for s in "ab")
    sim = text.name_similarity(F.col("a_column_name"), F.col("b_column_name"))
    known = {(n, rename(f.name)): profiles.kind_of(f.dataType) for n, df in tables.items() for f in df.schema.fields}
    found = a.join(b, F.col("a_dataset") < F.col("b_dataset")).withColumn("name_sim", sim).filter("name_sim > 0").collect()
    out = []
    for r in found:
        kinds = {known[r.a_dataset, r.a_column_name], known[r.b_dataset, r.b_column_name]}
        typed = len(kinds) == 1 and kinds <= {"int", "time", "date"}
        out.append(r.asDict() | {"pair": len(out), "form": "code" if typed else "word"})
    return out


def _sets(tables: dict[str, DataFrame], pairs: list[dict], rename) -> DataFrame:
    """dataset, column_name, form, code, word: the different trimmed, non-empty values of the columns in a pair, as typed codes where both sides have one type. Only these columns are read."""
    frames, names = [], []
    for name, df in tables.items():
        cells = []
        for f in df.schema.fields:
            forms = {p["form"] for p in pairs for s in "ab" if (p[f"{s}_dataset"], p[f"{s}_column_name"]) == (name, rename(f.name))}
            for form in sorted(forms):
                c = F.col(f"`{f.name}`")
                code = profiles.code_of(c, profiles.kind_of(f.dataType)) if form == "code" else F.lit(None).cast("long")
                word = F.lit(None).cast("string") if form == "code" else text.trimmed(S.as_text(c, f.dataType))
                cells.append(F.struct(F.lit(len(names)).alias("col"), code.alias("code"), word.alias("word")))
                names.append((len(names), name, rename(f.name), form))
        if cells:
            frames.append(df.select(F.inline(F.array(*cells))).filter("code is not null or word <> ''"))
    # a number per column is a shorter key than three texts; the names come back once per different value
    sets = reduce(DataFrame.unionByName, frames).distinct()
    return sets.join(F.broadcast(sets.sparkSession.createDataFrame(names, "col int, dataset string, column_name string, form string")), "col").select("dataset", "column_name", "form", "code", "word")


def overlap_bounds(sets: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, bound: at most so many values are shared, from k-minimum-value sketches and ranges alone.

    Below the smaller of two sketches' largest hashes both sets are known, so what they share there is counted; above it at most all that is left of the
    smaller side is shared. Integers share at most as many values as their ranges have in common. A column of at most SKETCH values is known whole.
    """
    hashed = sets.withColumn("h", F.xxhash64(F.coalesce(F.col("code").cast("string"), F.col("word"))))
    w = Window.partitionBy("dataset", "column_name", "form").orderBy("h")
    key = ["dataset", "column_name", "form"]
    sketch = scratch.stored(hashed.select(*key, "h").withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= SKETCH).drop("_at"), "sketches")
    tops = sketch.groupBy(*key).agg(F.max("h").alias("top"), F.count("*").alias("kept")).join(sizes, key)
    # a sketch that holds the whole set knows it up to the largest hash there is
    tops = tops.select(*key, "size", "low", "high", F.when(F.col("kept") >= F.col("size"), F.lit((1 << 63) - 1)).otherwise(F.col("top")).alias("top"))
    side = lambda df, s: df.select(*[F.col(c).alias(c if c == "form" else f"{s}_{c}") for c in df.columns])
    ends = pairs.join(side(tops, "a"), ["a_dataset", "a_column_name", "form"]).join(side(tops, "b"), ["b_dataset", "b_column_name", "form"]).withColumn("top", F.least("a_top", "b_top"))
    ends = scratch.stored(ends.select("pair", "form", "a_dataset", "a_column_name", "b_dataset", "b_column_name", "a_size", "b_size", "a_low", "a_high", "b_low", "b_high", "top"), "ends")
    below = lambda s: ends.join(side(sketch, s), [f"{s}_dataset", f"{s}_column_name", "form"]).filter(F.col(f"{s}_h") <= F.col("top")).select("pair", F.col(f"{s}_h").alias("h"))
    a, b = below("a"), below("b")
    known = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("pair", "h").agg(F.sum("s").alias("s"))
    known = known.groupBy("pair").agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s").isin(1, 3)).alias("in_a"), F.count_if(F.col("s").isin(2, 3)).alias("in_b"))
    counted = ends.join(known, "pair", "left").fillna(0, ["both", "in_a", "in_b"])
    by_sketch = F.col("both") + F.least(F.col("a_size") - F.col("in_a"), F.col("b_size") - F.col("in_b"))
    common = F.greatest(F.lit(0), F.least("a_high", "b_high").cast("double") - F.greatest("a_low", "b_low").cast("double") + 1)
    return counted.select("pair", F.when(F.col("form") == "code", F.least(by_sketch.cast("double"), common)).otherwise(by_sketch.cast("double")).alias("bound"))


def column_overlap(tables: dict[str, DataFrame], profile: DataFrame, min_overlap: float = 0.0, min_uniqueness: float = 0.0, rename=S.strip_prefix) -> DataFrame:
    """For columns of different tables with similar names: shared values, overlap, uniqueness of both, type match, and joined.

    profile: dataset, column_name, row_count, inferred_type, is_technical. Pairs are chosen from the profile; only the columns in a pair are read. With bounds, a pair
    whose sets can't reach min_overlap by their sketches, or neither of which is unique enough, isn't joined: its shared and overlap are null.
    """
    spark = profile.sparkSession
    found = _pairs(tables, profile, rename)
    schema = "a_dataset string, a_column_name string, a_row_count long, a_inferred_type string, b_dataset string, b_column_name string, b_row_count long, b_inferred_type string, name_sim double, pair int, form string"
    names = [c.split()[0] for c in schema.split(", ")]
    pairs = spark.createDataFrame([tuple(p[n] for n in names) for p in found], schema)
    sets = scratch.stored(_sets(tables, found, rename), "sets") if found else spark.createDataFrame([], "dataset string, column_name string, form string, code long, word string")
    key = ["dataset", "column_name", "form"]
    sizes = scratch.stored(sets.groupBy(*key).agg(F.count("*").alias("size"), F.min("code").alias("low"), F.max("code").alias("high")), "sizes")
    of = lambda s: sizes.select(F.col("dataset").alias(f"{s}_dataset"), F.col("column_name").alias(f"{s}_column_name"), "form", F.col("size").alias(f"{s}_size"))
    sided = pairs.join(of("a"), ["a_dataset", "a_column_name", "form"], "left").join(of("b"), ["b_dataset", "b_column_name", "form"], "left")
    least = F.least("a_size", "b_size")
    sided = sided.withColumns({"uniq_a": F.coalesce(F.col("a_size") / F.col("a_row_count"), F.lit(0.0)), "uniq_b": F.coalesce(F.col("b_size") / F.col("b_row_count"), F.lit(0.0))})
    may = F.greatest("uniq_a", "uniq_b") >= min_uniqueness
    if min_overlap > 0:
        sided = sided.join(overlap_bounds(sets, sizes, pairs.select("pair", "form", "a_dataset", "a_column_name", "b_dataset", "b_column_name")), "pair", "left")
        may = may & (F.coalesce(F.col("bound") / least, F.lit(0.0)) >= min_overlap)
    sided = scratch.stored(sided.withColumn("joined", may), "pairs")
    asked = F.broadcast(sided.filter("joined").select("pair", "form", "a_dataset", "a_column_name", "b_dataset", "b_column_name"))  # as many as the catalogue gives
    in_ = lambda s: asked.join(sets.withColumnsRenamed({"dataset": f"{s}_dataset", "column_name": f"{s}_column_name"}), [f"{s}_dataset", f"{s}_column_name", "form"]).select("pair", "code", "word")
    met = in_("a").unionByName(in_("b")).groupBy("pair", "code", "word").agg(F.count("*").alias("sides")).filter("sides = 2")
    out = sided.join(met.groupBy("pair").agg(F.count("*").alias("shared")), "pair", "left").withColumn("shared", F.when(F.col("joined"), F.coalesce("shared", F.lit(0))))
    same = F.when((F.col("a_inferred_type") == F.col("b_inferred_type")) & (F.col("a_inferred_type") != "unknown"), 1.0).otherwise(0.5)
    return out.withColumns({"overlap": F.when(~F.col("joined"), F.lit(None).cast("double")).when(least > 0, F.col("shared") / least).otherwise(0.0), "type_match": same})


def discover_foreign_keys(overlaps: DataFrame) -> DataFrame:
    """from (many) -> to (one) between tables, the most confident column pair per direction."""
    c = F.col
    is_match, pk_is_a, conf = key_decision(c("overlap"), c("uniq_a"), c("uniq_b"), c("name_sim"), c("type_match"))
    found = overlaps.withColumn("pk_is_a", pk_is_a).withColumn("confidence", conf).filter(is_match)
    pick = lambda x, y: F.when(c("pk_is_a"), c(x)).otherwise(c(y))
    edges = found.select(pick("b_dataset", "a_dataset").alias("from_dataset"), pick("a_dataset", "b_dataset").alias("to_dataset"), pick("b_column_name", "a_column_name").alias("label"), c("shared").alias("weight"), "confidence")
    w = Window.partitionBy("from_dataset", "to_dataset").orderBy(F.desc("confidence"), F.desc("weight"), "label")
    return edges.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def containment_edges(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """group (dataset, column) -> entity, weight the rows that hold one of its values. cells: one row per cell, or counted values with n. aliases: dataset, column_name, value, entity."""
    n = F.sum("n") if "n" in cells.columns else F.count("*")
    counted = cells.withColumn("value", text.trimmed(F.col("value"))).groupBy("dataset", "column_name", "value").agg(n.alias("n"))
    found = counted.join(aliases, ["dataset", "column_name", "value"]).groupBy("dataset", "column_name", "entity").agg(F.sum("n").alias("weight"))
    return found.withColumn("confidence", F.lit(0.9))


def attribute_groups(containment: DataFrame, columns: DataFrame) -> DataFrame:
    """dataset -> attribute group edges with their label, for columns that link a value at least."""
    used = containment.select("dataset", "column_name").distinct()
    return used.join(columns, ["dataset", "column_name"]).select("dataset", "column_name", text.edge_label(F.col("column_name"), F.col("role")).alias("label"), F.lit(1).alias("weight"), F.lit(0.9).alias("confidence"))


def pair_counts(wide: DataFrame, cols: list[str]) -> DataFrame:
    """pair, u, v, n: how many rows of `wide` hold two values in two of its columns. pair numbers the pairs of columns in their order.

    A task keeps an entry per different pair of values, not per different row: with many columns of few values those are far fewer.
    """
    pairs = [F.struct(F.lit(k).alias("pair"), F.col(x).alias("u"), F.col(y).alias("v")) for k, (x, y) in enumerate(combinations(cols, 2))]
    return wide.select(F.inline(F.array(*pairs))).groupBy("pair", "u", "v").agg(F.count("*").alias("n"))


def edges_of_pairs(pairs: DataFrame, roles: dict[str, str], labels=rules.PAIR_LABELS, entity=None) -> DataFrame:
    """Edges from counted pairs (pair_counts) of the columns in roles. entity(role, value): a value's entity, made once per pair; by default values are entities."""
    known = {(a, b): label for a, b, label in labels}
    ends = []
    for x, y in combinations(roles, 2):
        swap = (roles[y], roles[x]) in known
        label = known.get((roles[y], roles[x]) if swap else (roles[x], roles[y]))
        u, v = (F.col(c) if entity is None else entity(roles[r], F.col(c)) for c, r in (("u", x), ("v", y)))
        a, b = (v, u) if swap else (u, v)
        a, b = (a, b) if label else (F.least(a, b), F.greatest(a, b))
        ends.append(F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(label or "co_occurs_with").alias("edge_type")))
    out = pairs.select(reduce(lambda e, kv: F.when(F.col("pair") == kv[0], kv[1]).otherwise(e), enumerate(ends), F.lit(None)).alias("p"), "n").filter("p.from_id <> p.to_id")
    out = out.groupBy("p.from_id", "p.to_id", "p.edge_type").agg(F.sum("n").alias("weight"))
    return out.withColumn("confidence", F.least(0.4 + 0.1 * F.col("weight"), F.lit(0.95)))


def cooccurrence_edges(wide: DataFrame, roles: dict[str, str], labels=rules.PAIR_LABELS, entity=None) -> DataFrame:
    """Edges between the entities that meet in a row of `wide`, whose columns hold entities (or values, see edges_of_pairs) of the given roles."""
    # stored, so that no condition on entities moves below the count and makes them once per row
    return edges_of_pairs(scratch.stored(pair_counts(wide, list(roles)), "pairs"), roles, labels, entity)


def id_property_aliases(rows: DataFrame) -> DataFrame:
    """id_value -> entity of the name in the same row; the last row wins. rows: row_no, id_value, entity."""
    return rows.filter("id_value is not null and entity is not null").groupBy("id_value").agg(F.max_by("entity", "row_no").alias("entity"))


def skipped_datasets(catalogue: DataFrame, loaded: DataFrame) -> DataFrame:
    missing = catalogue.join(loaded.select("dataset").distinct(), "dataset", "left_anti")
    return missing.withColumn("warning", F.concat(F.lit("could not re-read "), F.col("dataset")))


def graph_view(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with alias counts, edges with the names and types of their ends)."""
    counts = aliases.groupBy("id").agg(F.count("*").alias("alias_count"))
    n = nodes.join(counts, "id", "left").withColumn("alias_count", F.coalesce("alias_count", F.lit(0)))
    end = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type"))
    return n, edges.join(end("from"), "from_id").join(end("to"), "to_id")


def entity_aliases(aliases: DataFrame, entity) -> DataFrame:
    return aliases.filter(F.col("id") == entity).orderBy("dataset", "column_name", "value")


def trace(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, keep=None) -> DataFrame:
    """id, depth: nodes within max_depth undirected steps of the seeds (id), over the edges that keep selects.

    One join per step with the last frontier only; nodes that have been reached don't come again.
    """
    some = edges if keep is None else edges.filter(keep)
    both = scratch.stored(some.select("from_id", "to_id").union(some.select("to_id", "from_id")).distinct().toDF("id", "next"), "steps")
    frontier = seeds.select("id").distinct()
    reached = scratch.stored(frontier.withColumn("depth", F.lit(0)), "reached")
    parts = [reached]
    for depth in range(1, max_depth + 1):
        fresh = both.join(parts[-1].select("id"), "id").select(F.col("next").alias("id")).distinct()
        fresh = reduce(lambda f, p: f.join(p.select("id"), "id", "left_anti"), parts, fresh)
        parts.append(scratch.stored(fresh.withColumn("depth", F.lit(depth)), "reached"))
        if parts[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, keep=None) -> DataFrame:
    """seed, id, depth: what each seed (seed, id) reaches within max_depth undirected steps over the edges that keep selects.

    All seeds walk at once: a step joins the last frontier with the edges, and a node that a seed has reached doesn't come again for it.
    """
    some = edges if keep is None else edges.filter(keep)
    both = scratch.stored(some.select("from_id", "to_id").union(some.select("to_id", "from_id")).distinct().toDF("id", "next"), "steps")
    parts = [scratch.stored(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)), "reached")]
    for depth in range(1, max_depth + 1):
        fresh = both.join(parts[-1].select("seed", "id"), "id").select("seed", F.col("next").alias("id")).distinct()
        fresh = reduce(lambda f, p: f.join(p.select("seed", "id"), ["seed", "id"], "left_anti"), parts, fresh)
        parts.append(scratch.stored(fresh.withColumn("depth", F.lit(depth)), "reached"))
        if parts[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def domain_seeds(nodes: DataFrame, domain: str) -> DataFrame:
    """seed, id: the dataset nodes (id, name, entity_type) of a business domain, each a seed of its own."""
    some = nodes.filter((F.col("entity_type") == "dataset") & (text.domain(F.col("name")) == domain))
    return some.select(F.col("id").alias("seed"), "id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, without=("co_occurs_with",)) -> tuple[DataFrame, DataFrame]:
    """(seed, id, depth; the induced edges): what lies around datasets. Edges of the types in `without` aren't walked, but they are among the induced ones."""
    around = reach(edges, seeds, hops, ~F.col("edge_type").isin(*without) if without else None)
    return around, induced(edges, around)


def collapsed(nodes: DataFrame, edges: DataFrame, groups: DataFrame, exclusive: bool = False, parent_type: str = "contains_reference") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that stay visible when the groups (id) are collapsed: their children go, with all edges that lose an end.

    exclusive: a child goes only if all its visible parents are collapsed; one that another group also holds stays.
    """
    held = edges.filter(F.col("edge_type") == parent_type).select(F.col("from_id").alias("id"), F.col("to_id").alias("child")).join(nodes.select("id"), "id", "left_semi")
    closed = groups.select("id").distinct().withColumn("closed", F.lit(True))
    parents = held.join(closed, "id", "left").groupBy("child").agg(F.count_if(F.col("closed")).alias("shut"), F.count("*").alias("all"))
    gone = parents.filter(F.col("shut") == F.col("all") if exclusive else F.col("shut") > 0).select(F.col("child").alias("id"))
    left = nodes.join(gone, "id", "left_anti")
    return left, induced(edges, left)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def without_types(nodes: DataFrame, edges: DataFrame, hidden) -> tuple[DataFrame, DataFrame]:
    left = nodes.filter(~F.col("entity_type").isin(*hidden))
    return left, induced(edges, left)


def build_stats(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(count(aliases, "aliases"))
