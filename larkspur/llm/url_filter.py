"""URL filters with dated lists, as a temporal join in built-in functions.

List entries say that a domain or a URL prefix was added or removed at some time. Per entry they become
validity intervals. Every different pair of a URL and a time looks up its host, the host's parent domains
and the prefixes of its URL, and an as-of join keeps the entries whose interval holds the time of the
fetch. A list of up to ``MOST_BROADCAST`` intervals is broadcast, so that the looked-up values, among
them hot ones such as a top-level domain, are not shuffled; a longer one is joined by value and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import fresh, others, quoted, settle

#: Intervals of a list that is broadcast.
MOST_BROADCAST = 250_000
#: Parts of a hot value in the join with a longer list.
SALTS = 16
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
HOST = SCHEME + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)"
PATH = SCHEME + "[^/?#]*([^?#]*)"
#: Addresses in numbers, which have no parent domains.
NUMERIC = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def trimmed(url: Column) -> Column:
    """A URL without white space at its ends."""
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and dots at its end; an IPv6 address with its brackets. Empty if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(trimmed(url), HOST, 1)), r"\.+$", "")


def parents(host: Column, most: Column | None = None) -> Column:
    """The host and its parent domains, longest first; of those, the ones of at most ``most`` labels. Addresses in numbers have no parents."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    first = F.greatest(F.lit(1), n - most + 1) if most is not None else F.lit(1)
    return F.when(host.rlike(NUMERIC), F.array(host)).otherwise(F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def prefixes(url: Column, most: Column | None = None) -> Column:
    """host/, host/a/, host/a/b ...: the URL without scheme, query and fragment, cut after each of its first ``most`` slashes (all by default), and whole."""
    path = F.regexp_extract(trimmed(url), PATH, 1)
    parts = F.split(path, "/", F.coalesce(most + 1, F.lit(-1)) if most is not None else -1)
    cuts = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    return F.transform(F.array_distinct(F.concat(F.filter(cuts, lambda p: p != ""), F.array(path))), lambda p: F.concat(host_of(url), p))


def validity(entries: DataFrame) -> DataFrame:
    """kind, value, valid_from, valid_to (null: still valid) from kind ("domain" or "prefix"), value, action ("add" or "remove") and at.

    Values are compared in lower case up to the first slash. Of entries of the same value and time an
    addition counts; a repeated addition lengthens nothing; removals of what isn't listed mean nothing.
    Entries with a null among their columns are void.
    """
    value = F.concat(F.lower(F.substring_index("value", "/", 1)), F.expr("substr(value, length(substring_index(value, '/', 1)) + 1)"))
    known = entries.select("kind", value.alias("value"), "at", "action").filter(F.col("kind").isin("domain", "prefix") & F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("at").isNotNull())
    states = known.groupBy("kind", "value", "at").agg(F.max(F.col("action") == "add").alias("listed"))
    history = Window.partitionBy("kind", "value").orderBy("at")
    turns = states.withColumn("before", F.coalesce(F.lag("listed").over(history), F.lit(False))).filter("listed <> before")
    ends = turns.withColumn("valid_to", F.lead("at").over(history))
    return ends.filter("listed").select("kind", "value", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Add host, blocked, n_entries, entry (the least matching value) and listed_since (its list date) to every capture.

    A capture with a null URL or time matches nothing; it, and one without a host, is not blocked.
    Repeated captures are judged each. Columns of these names, in any case, that ``captures`` has are
    replaced; others may have any name. Only URLs and times are looked up and shuffled before the last join.
    """
    made = ["host", "blocked", "n_entries", "entry", "listed_since"]
    kept = others(captures.columns, made)
    url, at = F.col(quoted(url_col)), F.col(quoted(time_col))
    intervals = settle(validity(entries))
    slashes = F.length("value") - F.length(F.replace("value", F.lit("/"), F.lit("")))
    labels = F.size(F.split("value", "\\."))
    # what the list can match at most: its size, the labels of its domains and the slashes of its prefixes
    listed = intervals.agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "domain", labels)).alias("labels"), F.max(F.when(F.col("kind") == "prefix", slashes)).alias("slashes")).first()
    asked = captures.filter(url.isNotNull() & at.isNotNull()).select(url.alias("url"), at.alias("at")).distinct().withColumn("host", host_of(F.col("url"))).filter("host <> ''")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    domains = F.transform(parents(F.col("host"), F.lit(listed["labels"])), lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value"))) if listed["labels"] else none
    starts = F.transform(prefixes(F.col("url"), F.lit(listed["slashes"])), lambda v: F.struct(F.lit("prefix").alias("kind"), v.alias("value"))) if listed["slashes"] is not None else none
    looked = asked.select("url", "at", F.explode(F.concat(domains, starts)).alias("k")).select("url", "at", "k.kind", "k.value")
    if listed["n"] <= most_broadcast:
        met = looked.join(F.broadcast(intervals), ["kind", "value"])
    else:
        salted = looked.withColumn("salt", F.pmod(F.xxhash64("url", "at"), F.lit(SALTS)).cast("int"))
        met = salted.join(intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "value", "salt"])
    active = met.filter((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    url_key, time_key, n, least = (fresh(captures.columns, f"capture_{x}") for x in ("url", "time", "n", "least"))
    hits = active.groupBy(F.col("url").alias(url_key), F.col("at").alias(time_key)).agg(F.count("*").alias(n), F.min(F.struct("value", "valid_from")).alias(least))
    rows = captures.select(*map(quoted, kept), url.alias(url_key), at.alias(time_key))
    # captures without a URL or time match nothing; they aren't shuffled to one partition for it
    known = F.col(url_key).isNotNull() & F.col(time_key).isNotNull()
    empty = rows.filter(~known).withColumns({n: F.lit(None).cast("long"), least: F.lit(None).cast(hits.schema[least].dataType)})
    rows = rows.filter(known).join(hits, [url_key, time_key], "left").select(*map(quoted, rows.columns), n, least).unionByName(empty)
    return rows.select(
        *map(quoted, kept),
        F.coalesce(host_of(F.col(url_key)), F.lit("")).alias("host"),
        F.col(n).isNotNull().alias("blocked"),
        F.coalesce(n, F.lit(0)).alias("n_entries"),
        F.col(f"{least}.value").alias("entry"),
        F.col(f"{least}.valid_from").alias("listed_since"),
    )
