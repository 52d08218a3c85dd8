"""Host and path rules over URLs, as a sort-merge range join.

A host in reversed labels (``a.example.net`` as ``net.example.a.``) starts with the reversed host of every
rule that covers it, so a rule covers one interval of the sorted keys, and intervals nest. Rules and URLs are sorted
together. Each rule carries the stack of rules that are open where it starts; sweeping on, the last rule
before a URL hands over its stack, and entries whose interval has ended before the URL drop out. That is
enough: any rule that covers a URL is also open at every rule between its own start and the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyledger.functions.steps import pinned
from storyledger.llm.runs import PART, sorted_parts
from storyledger.llm.text import ascii_lower, hidden

ENTRY = "struct<hostkey: string, path: string, rule: string, verdict: string>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot after it, so that a domain is a prefix of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules by host key: ``hostkey`` and ``stack``, the rules open there, outermost first.

    ``rules`` has ``host``, ``path``, ``verdict``. A stack is as deep as the host has labels with rules, times
    the paths of each.
    """
    entry = F.struct(
        F.col("hostkey"), F.coalesce("path", F.lit("")).alias("path"),
        F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), F.col("verdict"),
    )
    keyed = rules.where("host is not null").withColumn("hostkey", host_key(ascii_lower(F.col("host"))))
    own = keyed.groupBy("hostkey").agg(F.array_sort(F.collect_set(entry)).alias("own"))
    labels = F.split(F.col("hostkey"), r"\.")
    ups = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")),
    )
    climbed = own.select(F.col("hostkey").alias("at"), F.explode(ups).alias("hostkey"))
    return (
        climbed.join(own, "hostkey")
        .groupBy(F.col("at").alias("hostkey"))
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hostkey", "own"))), lambda x: x["own"])).alias("stack"))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, url: str, key: str, *, default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    Of the rules that fit, the one with the longest host wins, then the longest path. No rule: ``rule`` is
    null and the verdict is ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit
    no rule. Repeated URLs and keys each keep their row. Without rules or URLs the result is as defined for none.
    """
    kept = urls.drop("host", "path", "rule", "verdict")
    hostkey, kind, stack = (hidden(kept, x) for x in ("__hostkey", "__kind", "__stack"))
    split = pinned(kept, kept.columns, {"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    pages = split.withColumns({hostkey: host_key(F.col("host")), kind: F.lit(1), stack: F.lit(None).cast(f"array<{ENTRY}>")})
    opened = with_stacks(rules).select(F.col("hostkey").alias(hostkey), F.lit(0).alias(kind), F.col("stack").cast(f"array<{ENTRY}>").alias(stack))
    events = pages.unionByName(opened, allowMissingColumns=True)
    parts = sorted_parts(events, [hostkey, kind, key], "url-rules")

    # The stack that a part inherits: of the last rule in any part before it.
    last = parts.where(F.col(kind) == 0).groupBy(PART).agg(F.max_by(stack, hostkey).alias("__last"))
    numbers = parts.select(PART).distinct().join(last, PART, "left")
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    inherited = numbers.select(PART, F.last("__last", ignorenulls=True).over(earlier).alias("__inherited"))
    sweep = Window.partitionBy(PART).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    swept = parts.join(F.broadcast(inherited), PART).withColumn(  # one row a range partition
        stack, F.coalesce(F.last(stack, ignorenulls=True).over(sweep), F.col("__inherited"))
    )

    def fits(entry: Column) -> Column:
        return F.col(hostkey).startswith(entry["hostkey"]) & F.col("path").startswith(entry["path"])

    def rank(entry: Column) -> Column:
        return F.struct(
            F.length(entry["hostkey"]).alias("h"), F.length(entry["path"]).alias("p"),
            entry["rule"].alias("rule"), entry["verdict"].alias("verdict"),
        )

    found = F.array_max(F.transform(F.filter(F.col(stack), fits), rank))
    named = swept.where(F.col(kind) == 1).withColumn(stack, found)
    return named.select(
        *[F.col(f"`{c}`") for c in kept.columns], "host", "path", F.col(f"{stack}.rule").alias("rule"),
        F.coalesce(F.col(f"{stack}.verdict"), F.lit(default)).alias("verdict"),
    )
