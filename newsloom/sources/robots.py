"""Crawling rules of hosts: parsed once for each host, then held against addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest text and line that are read, and where lines end.
MOST_LINES, LONGEST_LINE = 2048, 2048
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def robots_rules(bodies: DataFrame, agent: str) -> DataFrame:
    """``host, available, delay, rules`` of each row of ``host, body``; ``rules`` are ``pattern, allow`` in order.

    The groups that name ``agent`` count, or those of ``*`` if none does. A body that is null, holds ``<``, is
    too long or has a malformed line makes the host unavailable, with no rules. A host has one body; its lines
    are bounded, so are the windows.
    """
    lines = F.split(F.regexp_replace("body", "^\ufeff", ""), _BREAK)
    fit = F.coalesce(~F.contains("body", F.lit("<")) & (F.size(lines) <= MOST_LINES) & ~F.exists(lines, lambda x: F.length(x) > LONGEST_LINE), F.lit(False))
    read = bodies.select("host", F.posexplode(F.when(fit, F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"(?U)^\s+|\s+$", "")))).alias("at", "line")).where("line <> ''")
    key = F.lower(F.regexp_extract("line", r"(?s)^([^:]*?)\s*:", 1))
    value = F.regexp_extract("line", r"(?s)^[^:]*:\s*(.*)$", 1)
    told = read.select("host", "at", "line", key.alias("key"), value.alias("value"))

    order = Window.partitionBy("host").orderBy("at")
    names, rule, pause = F.col("key") == "user-agent", F.col("key").isin("allow", "disallow"), F.col("key") == "crawl-delay"
    turn = F.when(names, "agent").when(rule | pause, "rule")
    before = F.last(turn, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = told.withColumns({"before": before, "seconds": F.expr("try_cast(value AS DOUBLE)")})
    grouped = grouped.withColumn("group", F.sum(F.when(names & (F.col("before") == "rule"), 1).otherwise(0)).over(order))
    early = F.col("before").isNull()
    bad = (
        ~F.contains("line", F.lit(":"))
        | ~F.col("key").rlike("^[a-z][a-z-]*$")
        | ((rule | pause) & early)
        | (pause & ~F.coalesce((F.col("seconds") >= 0) & (F.col("seconds") < float("inf")), F.lit(False)))
        | (rule & (F.col("value") != "") & ~F.col("value").startswith("/"))
        | (~names & ~rule & ~pause & early & (F.col("key") != "sitemap"))
    )
    within, whole = Window.partitionBy("host", "group"), Window.partitionBy("host")
    name = F.when(names, F.lower("value"))
    marked = grouped.select("host", "at", "key", "value", "seconds", bad.alias("bad"), F.max(name == agent.lower()).over(within).alias("own"), F.max(name == "*").over(within).alias("any"))
    marked = marked.withColumn("named", F.max("own").over(whole))
    chosen = F.when(F.col("named"), F.col("own")).otherwise(F.col("any"))
    entry = F.when(chosen & rule & (F.col("value") != ""), F.struct("at", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow")))
    parsed = marked.groupBy("host").agg(
        F.max("bad").alias("bad"),
        F.max(F.when(chosen & pause, F.col("seconds"))).alias("delay"),
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["pattern"].alias("pattern"), x["allow"].alias("allow"))).alias("rules"),
    )
    ready = F.col("fit") & ~F.coalesce("bad", F.lit(False))
    none = F.array().cast("array<struct<pattern:string,allow:boolean>>")
    return bodies.select("host", fit.alias("fit")).join(parsed, "host", "left").select(
        "host", ready.alias("available"), F.when(ready, F.coalesce("delay", F.lit(0.0))).alias("delay"), F.when(ready, F.coalesce("rules", none)).otherwise(none).alias("rules")
    )


def _fits(path: Column, pattern: Column) -> Column:
    """``*`` stands for anything, a ``$`` at the end for the end; all else is literal."""
    bare = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.transform(F.split(bare, r"\*", -1), lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.rlike(path, F.concat(F.lit(r"(?s)\A"), F.array_join(quoted, ".*"), F.when(pattern.endswith("$"), r"\z").otherwise("")))


def _weight(pattern: Column) -> Column:
    """Bytes of a pattern without its signs; an escaped byte is one."""
    bare = F.replace(F.regexp_replace(pattern, r"\$$", ""), F.lit("*"), F.lit(""))
    return F.octet_length(bare) - F.regexp_count(bare, F.lit("%[0-9A-Fa-f]{2}")) * 2


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, host, available, allowed`` of each row of ``url``: the heaviest rule that fits decides, allowing before forbidding.

    Without a fitting rule the address is allowed; ``allowed`` is null where the host's rules are unavailable or not known.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    met = urls.select("url", host.alias("host"), path.alias("path")).join(rules, "host", "left")
    fitting = F.filter("rules", lambda r: _fits(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(_weight(r["pattern"]).alias("weight"), r["allow"].alias("allow"))))
    return met.select("url", "host", F.coalesce("available", F.lit(False)).alias("available"), F.when(F.col("available"), F.coalesce(best["allow"], F.lit(True))).alias("allowed"))
