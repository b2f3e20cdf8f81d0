"""URL filter: rules first, then the likelihood ratio of two character models. DataFrame functions only.

The URLs that the rules allow and those that they block train two variable-order Markov models over characters: orders 0 to ORDER,
each smoothed into the next shorter one in proportion to how many different characters followed the context
(Witten-Bell). The score of a URL is the mean, over its lower-cased characters, of the difference of the two log-likelihoods. The models learn from four fifths
of the URLs that have a rule (by a hash of the URL, so copies stay together); the threshold is
calibrated on the rest, where the share of allowed URLs below it and that of blocked URLs above it are
least in sum. All statistics cover all rows. Positions are counted per distinct (context, character) before they meet the model,
and scoring joins them salted by page, since a few of them occur in almost every URL.

Null and malformed URLs (no `://`): empty host and path, no rule, and the model's verdict on the text (a null or empty URL has
score 0). No allowed or no blocked URLs to learn from: all scores are what the smoothing gives; none to calibrate with: the threshold is 0. Repeated rows and ids get a row
each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

ORDER = 4
SALT = 32
#: One of so many folds calibrates.
FOLDS = 5
#: Bins of the calibration's histogram; the scores between -RANGE and RANGE are told apart.
BINS, RANGE = 4096, 8.0
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (the longest) and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _model(grams: DataFrame) -> DataFrame:
    """gram, value: for each (context, character) of the corpus the difference of its log-probabilities."""
    below = None
    for order in range(ORDER + 1):
        level = grams.select(F.expr(f"right(gram, {order + 1})").alias("gram"), "allow", "block").groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        # at most one row per character, and per pair of characters in the next order: a bound that no corpus moves
        context = level.groupBy(F.expr(f"left(gram, {order})").alias("context")).agg(*[x for side in ("allow", "block") for x in (F.sum(side).alias(f"n_{side}"), F.count_if(F.col(side) > 0).alias(f"t_{side}"))])
        level = level.withColumn("context", F.expr(f"left(gram, {order})")).join(context, "context")
        if below is None:
            level = level.withColumn("p_allow", F.lit(1 / 256)).withColumn("p_block", F.lit(1 / 256))
        else:
            level = level.withColumn("short", F.expr(f"right(gram, {order})")).join(below.withColumnRenamed("gram", "short"), "short")
        for side in ("allow", "block"):
            total = F.col(f"n_{side}") + F.col(f"t_{side}")
            level = level.withColumn(f"p_{side}", F.when(total > 0, (F.col(side) + F.col(f"t_{side}") * F.col(f"p_{side}")) / total).otherwise(F.col(f"p_{side}")))
        below = scratch.stored(level.select("gram", "p_allow", "p_block"), f"order{order}")
    return below.select("gram", (F.log("p_allow") - F.log("p_block")).alias("value"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and the calibrated threshold, one row per row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = judged(F.col("host"), F.col("path"), rules)
    held = F.crc32(F.encode(F.coalesce("url", F.lit("")), "UTF-8")) % FOLDS == 0
    rows = rows.select("page_id", F.lower("url").alias("low"), held.alias("calibrates"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("said", said)
    rows = scratch.stored(rows.withColumn("row", F.monotonically_increasing_id()), "urls")

    padded = F.concat(F.lit(" " * ORDER), F.col("low"))
    places = F.explode(F.sequence(F.lit(1), F.length("low")))
    taught = F.when(~F.col("calibrates"), F.col("said"))
    known = rows.filter(F.length("low") > 0)
    at = known.select("row", taught.alias("said"), padded.alias("text"), places.alias("i")).select("row", "said", F.expr(f"substring(text, i, {ORDER + 1})").alias("gram"))
    grams = scratch.stored(at.groupBy("gram").agg(F.count_if(F.col("said") == "allow").alias("allow"), F.count_if(F.col("said") == "block").alias("block")), "grams")

    salts = F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("salt")
    values = scratch.stored(_model(grams), "values").select("gram", "value", salts)
    counted = at.groupBy("row", "gram").count().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    sums = counted.join(values, ["gram", "salt"]).groupBy("row").agg(F.sum(F.col("value") * F.col("count")).alias("total"))
    scored = scratch.stored(rows.join(sums, "row", "left").withColumn("score", F.coalesce(F.col("total") / F.length("low"), F.lit(0.0))), "scored")

    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + RANGE) * (BINS / (2 * RANGE))))).cast("int")
    histogram = scored.filter("said is not null and calibrates").groupBy(bin_.alias("bin")).agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b"))
    threshold, allowed, blocked, missed, least = 0.0, 0, 0, 0, None
    bins = sorted(histogram.collect())  # BINS rows at most
    allowed, blocked = sum(r.a for r in bins), sum(r.b for r in bins)
    if allowed and blocked:
        kept = blocked
        for i, r in enumerate(bins):
            missed, kept = missed + r.a, kept - r.b
            error = missed / allowed + kept / blocked
            if least is None or error < least:
                after = bins[i + 1].bin if i + 1 < len(bins) else r.bin + 1
                least, threshold = error, (r.bin + 1 + after) / 2 * (2 * RANGE / BINS) - RANGE
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every url of pages with its host, path, rule and verdict."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
