"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule names a host and a path prefix and fits the host, all its subdomains,
and every path that begins with the prefix.  Keys are canonical: a host's
labels in reversed order, a path's bytes.  In the order of the keys a rule's
host is an interval, which holds the host and its subdomains, and so is its
path; intervals are nested or disjoint.  Interval begins, interval ends and
urls are sorted together and swept.  The sweep keeps the stack of the active
intervals: a begin pushes, an end pops, and a url reads it.

The first sweep goes over hosts and gives each url the rules' hosts that are
active there, the second one goes over the paths under each of these hosts.
The top of the second stack is the longest rule that fits under a host; the
longest over the url's few active hosts decides.

Urls are salted by their number, and rules repeated for each salt, so that a
host with a large share of the urls is swept in many tasks.  Urls under a top
label that no rule has are not swept.

Defined results: a null url or one without ``://`` has empty host and path and
fits no rule; of rules with equal host and path a block wins; a rule without a
host fits nothing; no rules and an empty table are allowed; null and repeated
ids are kept as they are; a very long host or path is one row with one key,
whose size is that of the url; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "verdict string, host string, path string"
#: Urls that share a salt, about; and the least number of salts, so that a hot host is spread in small tables as well.
URLS_A_SALT, LEAST_SALTS = 500_000, 64
#: Top labels up to this number are broadcast, to leave out other urls; more are joined.
LARGEST_BROADCAST = 10_000
#: Behind every key that begins so.
END = "~"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1)


def _bytes(text: F.Column) -> F.Column:
    """Text in the order of the bytes, in which only 0-9 and A-F occur."""
    return F.hex(F.encode(text, "UTF-8"))


def _host_key(host: F.Column) -> F.Column:
    """Reversed labels, each with a dot behind, which sorts before all that may stand in a label."""
    return F.concat(F.array_join(F.transform(F.reverse(F.split(host, r"\.", -1)), _bytes), "."), F.lit("."))


def _top(host_key: F.Column) -> F.Column:
    return F.substring_index(host_key, ".", 1)


def _events(rules: DataFrame, under: str, key: F.Column, item: F.Column) -> DataFrame:
    """Two rows for each interval, its begin (step 1) and its end (step -1)."""
    step = F.explode(F.array(F.lit(1), F.lit(-1)))
    rows = rules.select(F.col(under).alias("under"), key.alias("at"), item.alias("item"), step.alias("step"))
    return rows.withColumn("at", F.when(F.col("step") < 0, F.concat("at", F.lit(END))).otherwise(F.col("at"))).withColumn("kind", F.lit(0))


def _deepest(events: DataFrame) -> int:
    """The greatest height of the stack, from the rules alone."""
    order = W.partitionBy("under").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.select(F.sum("step").over(order).alias("depth")).agg(F.max("depth")).first()[0] or 0


def _swept(urls: DataFrame, events: DataFrame, salts: int) -> DataFrame:
    """urls (under, at, row_no and others) with ``stack``: the items of the active intervals, the innermost last."""
    salted = urls.withColumns({"salt": F.pmod(F.xxhash64("row_no"), F.lit(salts)), "kind": F.lit(1), "step": F.lit(0)})
    repeated = events.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    sweep = W.partitionBy("under", "salt").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = salted.unionByName(repeated, allowMissingColumns=True).withColumn("depth", F.sum("step").over(sweep))
    # What was pushed last at a height is on the stack as long as the stack is that high.
    pushed = lambda n: F.last(F.when((F.col("step") == 1) & (F.col("depth") == n), F.col("item")), ignorenulls=True).over(sweep)
    rows = rows.withColumn("stack", F.slice(F.array(*[pushed(n) for n in range(1, _deepest(events) + 1)]), F.lit(1), F.col("depth").cast("int")))
    return rows.where("kind = 1").select(*urls.columns, "stack")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", urls_a_salt: int = URLS_A_SALT) -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule, or null), verdict.

    ``rules`` has the columns of RULE_SCHEMA; "block" sorts after "allow".
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row_no"))
    rules = rules.where("host <> '' AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    output = lambda rows, top: rows.select(
        F.col("id").alias(id_col), "host", "path", F.concat(top["host"], top["path"]).alias("rule"), F.coalesce(top["verdict"], F.lit(default)).alias("verdict")
    )
    rule = F.struct("host", "path", "verdict")
    none = F.lit(None).cast("struct<host: string, path: string, verdict: string>")
    hosts = rules.select("host", _host_key(F.col("host")).alias("at")).distinct().withColumn("top", _top(F.col("at")))
    tops = hosts.select(F.col("top").alias("under")).distinct()
    n_tops = tops.count()
    if not n_tops:
        return output(urls, none)
    salts = max(LEAST_SALTS, 1 + pages.count() // urls_a_salt)
    tops = F.broadcast(tops) if n_tops <= LARGEST_BROADCAST else tops
    keyed = urls.withColumn("at", _host_key(F.col("host"))).withColumn("under", _top(F.col("at")))
    active = _swept(keyed.join(tops, "under", "left_semi"), _events(hosts, "top", F.col("at"), F.col("host")), salts)
    elsewhere = output(keyed.join(tops, "under", "left_anti").unionByName(active.where(F.size("stack") == 0).drop("stack")), none)
    under_host = active.select("id", "host", "path", "row_no", F.explode("stack").alias("under"), _bytes(F.col("path")).alias("at"))
    fitting = _swept(under_host, _events(rules, "host", _bytes(F.col("path")), rule), salts).withColumn("top", F.try_element_at("stack", F.lit(-1)))
    longest = F.max(F.when(F.col("top").isNotNull(), F.struct(F.length(F.concat("top.host", "top.path")).alias("n"), F.length("top.host").alias("m"), "top"))).alias("best")
    decided = fitting.groupBy("row_no", "id", "host", "path").agg(longest)
    return output(decided, F.col("best.top")).unionByName(elsewhere)
