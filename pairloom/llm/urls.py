"""URL filters by a sort-merge range join.

A host's labels are reversed, so a host and all its subdomains are one interval
of keys: ``example.com`` is ``com.example.`` up to ``com.example/``. Rules and
urls are dealt into ranges of keys by sampled cut points and sorted together; a
sweep over a range keeps the stack of nested hosts whose intervals are open: the
stack of the last host passed, less those whose interval has ended. Only
DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import choose_ranges, field, packed, range_index, sampled_cuts, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS_PER_RANGE = 200_000
ALLOW, BLOCK = "allow", "block"
RULE_COLUMNS = "verdict string, host string, path string"
# The rules of the registered query (fixed values).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it. The keys
    under ``x.`` are those from ``x.`` up to ``x/``, the next character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """One row per host with rules: ``h_key``, and ``stack``, the rules of the
    host and of every host it lies under, each with the end of its interval."""
    own = rules.groupBy("h_key").agg(
        F.collect_set(
            F.struct(
                F.concat(F.expr("substring(h_key, 1, length(h_key) - 1)"), F.lit("/")).alias("end"),
                "path", "verdict", "rule", F.length("h_key").alias("depth"),
            )
        ).alias("own")
    )
    labels = F.split(F.expr("substring(h_key, 1, length(h_key) - 1)"), r"\.")
    heads = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.concat(F.array_join(F.slice("labels", 1, i), "."), F.lit(".")),
    )
    outer = own.withColumn("labels", labels).select("h_key", F.explode(heads).alias("o_key"))
    above = own.select(F.col("h_key").alias("o_key"), "own")
    return outer.join(above, "o_key").groupBy("h_key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def filter_urls(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW
) -> DataFrame:
    """One row per row of ``urls``: ``row``, ``host``, ``path``, ``rule`` (host
    and path of the winner, else null) and ``verdict``.

    ``rules`` holds (verdict, host, path). A rule fits its host and all
    subdomains if the path starts with the rule's; the longest host and path
    wins, then the longer host, then a block. Null urls and urls without ``://``
    have an empty host and path and get ``default``, as does any url that no rule
    fits. Rules with a null or empty host are ignored, a null path is empty. Empty
    tables are fine on both sides.
    """
    cleaned = packed(rules).select(
        F.translate(field("host"), UPPER, UPPER.lower()).alias("host"),
        F.coalesce(field("path"), F.lit("")).alias("path"),
        field("verdict").alias("verdict"),
    )
    cleaned = cleaned.where("host <> ''").distinct()
    cleaned = cleaned.withColumn("rule", F.concat("host", "path")).withColumn(
        "h_key", reversed_host(F.col("host"))
    )
    stacks = written(_stacks(cleaned), "rule-stacks")

    rows = packed(urls).select(
        "row", host_of(field(url_col)).alias("host"), path_of(field(url_col)).alias("path")
    )
    # A hot host is spread over ranges by a hash of the whole url.
    rows = rows.withColumn("h_key", reversed_host(F.col("host")))
    salt = F.hex(F.xxhash64(field(url_col)))
    place = F.concat(F.hex(F.col("h_key").cast("binary")), F.lit("!"), salt)
    n_rows = rows.count()
    n_ranges = choose_ranges(n_rows, ROWS_PER_RANGE)
    cuts = sampled_cuts(rows.select(place.alias("place")), "place", n_rows, n_ranges)

    # Where a range begins, the sweep knows the last host passed before it.
    starts = stacks.select(
        range_index(F.hex(F.col("h_key").cast("binary")), cuts).alias("range"), "h_key", "stack"
    )
    last = starts.groupBy("range").agg(F.max(F.struct("h_key", "stack")).alias("last"))
    every = urls.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("range"))
    passed = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(last, "range", "left").select(
        "range", F.last("last", ignorenulls=True).over(passed).alias("last")
    )
    markers = starts.unionByName(
        carried.where("last is not null").select(
            "range", F.lit("").alias("h_key"), F.col("last.stack").alias("stack")
        )
    )
    points = rows.withColumn("range", range_index(place, cuts))
    # Rows of both kinds in one sorted sequence; a host's marker comes before
    # the urls of the host itself.
    both = points.select("range", "h_key", F.lit(1).alias("kind"), "row", "host", "path").unionByName(
        markers.withColumn("kind", F.lit(0)), allowMissingColumns=True
    )
    sweep = (
        Window.partitionBy("range")
        .orderBy("h_key", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter(
        "open", lambda r: (F.col("h_key") < r["end"]) & F.startswith(F.col("path"), r["path"])
    )
    best = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                F.length(r["rule"]).alias("length"), r["depth"].alias("depth"),
                r["verdict"].alias("verdict"), r["rule"].alias("rule"),
            ),
        )
    )
    judged = swept.withColumn("best", best)
    return judged.select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
