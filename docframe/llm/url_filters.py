"""URL filters by a temporal join with dated list entries (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Intervals that are broadcast; more are joined by pattern and month.
BROADCAST_INTERVALS = 20_000
#: Captures of one pattern from which it is dealt out, and to how many parts.
HOT_CAPTURES = 1_000_000
SALTS = 64
#: Actions of an entry. "remove" ends what the list said of the pattern before.
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def url_host(url: Column) -> Column:
    """Lower-case host without login, port and closing dot, an IPv6 address in its brackets; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def list_pattern(pattern: Column) -> Column:
    """A listed pattern as it is compared: the host in lower case, then the path as it is, if any, with single
    slashes and none at its end."""
    single = F.rtrim(F.regexp_replace(pattern, "/+", "/"), F.lit("/"))
    host = F.substring_index(single, "/", 1)
    return F.concat(F.rtrim(F.lower(host), F.lit(".")), F.substring(single, F.length(host) + 1, F.length(single)))


def url_patterns(url: Column, segments_most: int) -> Column:
    """The patterns that match a URL: its host, each parent domain of two labels or more (an address has none), and
    the host with its first path segments, up to segments_most of them."""
    labels = F.split(url_host(url), r"\.")
    n = F.size(labels)
    address = url_host(url).rlike(r"^(\[|[0-9.]+$)")
    first = F.sequence(F.lit(1), F.when(address, 1).otherwise(F.greatest(n - 1, F.lit(1))))
    domains = F.transform(first, lambda i: F.array_join(F.slice(labels, i, n), "."))
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    depth = F.least(F.size(segments), F.lit(segments_most))
    paths = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat_ws("/", F.array(url_host(url)), F.slice(segments, 1, i))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(url_host(url).isNotNull(), F.array_distinct(F.concat(domains, paths)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (list_name, pattern, action, listed_at) as intervals (..., valid_from, valid_to).

    What a list says of a pattern holds from its date until the list's next entry for the pattern, or
    without end (null). Case counts only in a pattern's path; a closing slash does not count. Of several entries at
    one time the last action by name counts. Entries without pattern, action or date are ignored; "remove" leaves a
    gap.
    """
    dated = (
        entries.select(F.coalesce("list_name", F.lit("")).alias("list_name"), list_pattern(F.col("pattern")).alias("pattern"), "action", "listed_at")
        .where("pattern is not null and action is not null and listed_at is not null")
        .groupBy("list_name", "pattern", "listed_at")
        .agg(F.max("action").alias("action"))
    )
    later = Window.partitionBy("list_name", "pattern").orderBy("listed_at")
    return dated.select(
        "list_name", "pattern", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(later).alias("valid_to")
    ).where(F.col("action") != REMOVE)


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def _active(keyed: DataFrame, intervals: DataFrame) -> DataFrame:
    """keyed (pattern, at, ...) with the intervals of the same pattern that hold at that time."""
    holds = "valid_from <= at and (valid_to is null or at < valid_to)"
    if intervals.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        return keyed.join(F.broadcast(intervals), "pattern").where(holds)
    hot = keyed.groupBy("pattern").count().where(F.col("count") >= HOT_CAPTURES).select("pattern", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    span = keyed.agg(F.max(_month(F.col("at")))).first()[0] or 0
    last = F.greatest(F.least(F.coalesce(_month(F.col("valid_to")), F.lit(span)), F.lit(span)), _month(F.col("valid_from")))
    dealt = (
        intervals.withColumn("month", F.explode(F.sequence(_month(F.col("valid_from")), last)))
        .join(hot, "pattern", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    )
    salted = keyed.withColumn("month", _month(F.col("at"))).join(hot, "pattern", "left").withColumn("salt", F.pmod(F.xxhash64("id", "url", "at"), salts).cast("int")).drop("salts")
    return salted.join(dealt, ["pattern", "month", "salt"]).where(holds)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """One row per capture: id, url, fetch time, host, n_active, pattern, list_name, action, blocked.

    A capture is judged by the entries that were active when it was fetched: n_active counts them; of
    them the longest pattern decides, then the later date, then list name and action in order. blocked
    is true if that entry's action is "block". Captures without URL, host or time match nothing and are
    not blocked. Repeated captures each get a row. Path patterns match at any depth: of a URL as
    many segments are tried as the deepest listed pattern has. Other columns are ignored; empty tables work.

    The as-of join is an equi-join on pattern and then a comparison of times. Few intervals are broadcast, and
    captures stay where they are read. More are joined by pattern and calendar month, to which the intervals are
    dealt; a pattern with very many captures is dealt out by the capture's hash as well, with a copy of its intervals
    for each part, so that a host with a third of all captures of one month is no single key.
    """
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    intervals = validity_intervals(entries)
    deepest = intervals.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"))))).first()[0] or 0
    keyed = own.distinct().select("id", "url", "at", F.explode(url_patterns(F.col("url"), deepest)).alias("pattern"))
    found = _active(keyed, intervals)
    best = F.struct(
        F.length("pattern").alias("size"),
        F.col("valid_from"),
        F.col("list_name"),
        F.col("action"),
        F.col("pattern"),
    )
    judged = found.groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("n_active"), F.max(best).alias("best"))
    mine, theirs = own.alias("o"), judged.alias("j")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("id", "url", "at")]
    return mine.join(theirs, same[0] & same[1] & same[2], "left").select(
        F.col("o.id").alias(id_col),
        F.col("o.url").alias(url_col),
        F.col("o.at").alias(time_col),
        url_host(F.col("o.url")).alias("host"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.list_name").alias("list_name"),
        F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") == BLOCK, F.lit(False)).alias("blocked"),
    )
