"""Column functions on names and values. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    return F.lower(trimmed(c))


def first_match(c: Column, patterns, otherwise: Column) -> Column:
    """The value of the first pattern that a (lower-cased) column matches."""
    return reduce(lambda out, p: F.when(F.lower(c).rlike(p[0]), F.lit(p[1])).otherwise(out), reversed(list(patterns)), otherwise)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal letters and digits, 0.65 if one name holds the other, else 0."""
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (a, b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.65).otherwise(0.0)


def value_overlap(a: Column, b: Column) -> Column:
    """Shared normalised samples over the smaller set's size; 0 for an empty set."""
    a, b = (F.array_distinct(F.transform(F.filter(x, lambda v: v.isNotNull()), normalised)) for x in (a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def looks_like_code(samples: Column) -> Column:
    """Whether six in ten of the filled samples are short and shaped like a code."""
    filled = F.filter(F.transform(samples, trimmed), lambda v: v.isNotNull() & (v != ""))
    codes = F.filter(filled, lambda v: (F.length(v) <= 10) & v.rlike(r"^[A-Za-z]{0,6}[-_ ]?\d+[A-Za-z0-9-]*$"))
    return F.when(F.size(filled) > 0, F.size(codes) / F.size(filled) >= 0.6).otherwise(False)


def is_id_name(name: Column) -> Column:
    n = trimmed(name)
    return F.lower(n).rlike(r"(^|[\s_-])id$") | n.rlike(r"[a-z]ID$")


def edge_label(name: Column, role: Column) -> Column:
    by_role = F.concat(F.lit("HAS_"), F.coalesce(F.nullif(F.upper(role), F.lit("")), F.lit("VALUE")))
    return first_match(name, rules.EDGE_NAME_LABELS, by_role)


def domain(name: Column) -> Column:
    return first_match(name, rules.DOMAINS, F.lit("General Domain"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*rules.STOP_WORDS))


def lexical_score(source: Column, path: Column, search_text: Column) -> Column:
    """Share of the source's tokens that the category's text holds."""
    hay, own = F.lower(F.concat_ws(" ", path, search_text)), tokens(source)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda t: hay.contains(t))) / F.size(own)).otherwise(0.0)


def rule_label(context: Column, path: Column, layer: Column, table=rules.RESOURCE_RULES) -> Column:
    """The label of the first rule whose two patterns match; null outside the resource layer."""
    found = reduce(lambda out, r: F.when(F.lower(context).rlike(r[0]) & F.lower(path).rlike(r[1]), F.lit(r[2])).otherwise(out), reversed(table), F.lit(None).cast("string"))
    return F.when(layer == "resource_tower", found)


def parsed_date(c: Column) -> Column:
    """A timestamp by the first of the declared layouts that fits; null if none does."""
    layouts = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy", "yyyy/M/d")
    # every layout begins with three numbers: what doesn't isn't tried six times
    return F.when(c.rlike(r"^[-+]?\d+[-/]\d+[-/]\d"), F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in layouts]))


def parsed_number(c: Column) -> Column:
    """A text as a double; null if it is none. What holds a letter that no number has isn't tried: a failed cast costs an exception."""
    return F.when(c.rlike(r"(?i)^[\x00-\x20]*[-+]?([.\d][.\da-fpx+-]*|nan|inf(inity)?)[\x00-\x20]*$"), c.try_cast("double"))


def iso_date(c: Column) -> Column:
    """M/D/YYYY, D-M-YYYY, D.M.YYYY, YYYY/M/D or an ISO date as ISO text, else null."""
    t = trimmed(c)
    part = lambda p, i, n=2: F.lpad(F.regexp_extract(t, p, i), n, "0")
    us, eu, slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    return (
        F.when(t.rlike(us), F.concat_ws("-", part(us, 3, 4), part(us, 1), part(us, 2)))
        .when(t.rlike(eu), F.concat_ws("-", part(eu, 3, 4), part(eu, 2), part(eu, 1)))
        .when(t.rlike(slash), F.concat_ws("-", part(slash, 1, 4), part(slash, 2), part(slash, 3)))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    )
