"""URL filters with dated lists: a temporal (as-of) join (operator 6).

List entries are dated actions: on ``at``, ``list`` adds or removes a pattern,
either a domain (it matches the host and all its subdomains) or a URL prefix
(host and path, cut at whole path segments).  Actions become validity
intervals [from, to); each capture is judged by the entries that were active
when it was fetched.

The join is an equality join on (pattern, period): an interval is laid out
over the periods that it touches within the captures' time span, and a capture
looks up its own period.  So neither a host that a third of the captures share
nor a pattern with thousands of intervals meets in one group: the first
spreads over its periods and is split at run time, the second's intervals of
other periods are never met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import stored

PERIOD_DAYS = 30
_FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port and final dot; null if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(raw), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a URL without its query, fragment and slashes at either end; runs of slashes are one."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.btrim(F.regexp_replace(raw, "/+", "/"), F.lit("/"))


def patterns_of(url: Column, labels: Sequence[int], steps: Sequence[int]) -> Column:
    """The patterns that match a URL among those of the given sizes.

    ``labels``: the label counts of domains (the host's last labels, the whole
    host included); ``steps``: the step counts of URL prefixes (host and that
    many path steps).  Only sizes that list entries have need to be given, so a
    URL costs its length times the number of sizes, however many steps it has.
    """
    host, path = host_of(url), path_of(url)

    def parts(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark))) + 1

    def cut(sizes: Sequence[int], most: Column, make) -> Column:
        each = [F.when(F.lit(k) <= most, make(k)) for k in sorted(set(sizes))]
        return F.array(*each) if each else F.array().cast("array<string>")

    domains = cut(labels, parts(host, "."), lambda k: F.substring_index(host, ".", -k))
    prefixes = cut(steps, F.when(path != "", parts(path, "/")).otherwise(0),
                   lambda k: F.concat(host, F.lit("/"), F.substring_index(path, "/", k)))
    return F.when(host.isNotNull(), F.array_compact(F.concat(domains, prefixes)))


def sizes_of(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """The label counts of the domains and the step counts of the URL prefixes in
    ``patterns``: two lists of distinct small numbers, not longer than the longest pattern."""
    n = F.col("pattern")
    steps = F.length(n) - F.length(F.replace(n, F.lit("/")))
    size = F.when(steps > 0, steps).otherwise(F.length(n) - F.length(F.replace(n, F.lit("."))) + 1)
    found = patterns.select((steps > 0).alias("path"), size.alias("size")).distinct().collect()
    return [r["size"] for r in found if not r["path"]], [r["size"] for r in found if r["path"]]


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, from_day, to_day: when each list held each pattern.

    ``entries``: list, pattern, at (date), action ('add' or 'remove').  Of
    several actions of a day on one pattern of a list, 'remove' counts.  An
    add that follows an add changes nothing.  Rows with a null field or another
    action are left out.
    """
    days = (entries.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
            .groupBy("list", "pattern", F.col("at").cast("date").alias("at")).agg(F.max("action").alias("action")))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    change = days.withColumn("was", F.lag("action").over(w)).where("was is null or was <> action")
    spans = change.withColumn("to_day", F.coalesce(F.lead("at").over(w), F.lit(_FAR).cast("date")))
    return spans.where("action = 'add'").select("list", "pattern", F.col("at").alias("from_day"), "to_day")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD_DAYS).cast("int")


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, list, pattern: every entry active for a capture when it was fetched.

    ``captures``: page_id, url, fetched (date).  Captures with a null date or
    without a host match nothing; repeated captures match each.  URLs may be of
    any length.  Other columns are ignored.
    """
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("fetched").cast("date").alias("fetched"))
    # Intervals are laid out over the captures' time span only.
    span = rows.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).first()
    if span["lo"] is None:
        return rows.select("page_id", "url", "fetched", F.lit("").alias("list"), F.lit("").alias("pattern")).where("false")
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    held = (intervals(entries).where((F.col("from_day") <= hi) & (F.col("to_day") > lo))
            .withColumn("p", F.explode(F.sequence(_period(F.greatest("from_day", lo)), _period(F.least("to_day", hi))))))
    # Stored, so that both inputs of the join are plain shuffles and a hot host is split.
    held = stored(held, "url-intervals")
    keys = (rows.where("fetched is not null")
            .select("page_id", "url", "fetched", F.explode(patterns_of(F.col("url"), *sizes_of(held))).alias("key"))
            .withColumn("period", _period(F.col("fetched"))))
    on = (F.col("key") == F.col("pattern")) & (F.col("period") == F.col("p")) & (F.col("fetched") >= F.col("from_day")) & (F.col("fetched") < F.col("to_day"))
    return keys.join(held, on).select("page_id", "url", "fetched", "list", "pattern")


def judge(captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
    """page_id, fetched, verdict, list, pattern for every capture.

    The most specific active pattern (the longest; ties: a block before an
    allow, then the smaller list name) decides: 'allowed' on the list
    ``allow``, else 'blocked'; without one, 'unlisted' and null list and
    pattern.  Captures that repeat id, url and date get their verdict once each.
    """
    found = active_entries(captures, entries)
    rank = F.struct((-F.length("pattern")).alias("n"), (F.col("list") == allow).alias("allowed"), F.col("list").alias("list"), F.col("pattern").alias("pattern"))
    best = stored(found.groupBy("page_id", "url", "fetched").agg(F.min(rank).alias("b")), "url-best")
    best = best.select(F.col("page_id").alias("i"), F.col("url").alias("u"), F.col("fetched").alias("f"), "b")
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("fetched").cast("date").alias("fetched"))
    out = rows.join(best, F.col("page_id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
    verdict = F.when(F.col("b").isNull(), "unlisted").when(F.col("b.allowed"), "allowed").otherwise("blocked")
    return out.select("page_id", "fetched", verdict.alias("verdict"), F.col("b.list").alias("list"), F.col("b.pattern").alias("pattern"))


# ---- stand-in inputs from the test tables --------------------------------------

def _hex(text: Column, first: int) -> Column:
    """A number from 0 to 65535 out of four hex digits of the text's md5."""
    return F.conv(F.substring(F.md5(text), first, 4), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures: ``fetched`` is a day of 2023 or 2024 from a hash of the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), _hex(F.col("page_id").cast("string"), 1) % 730).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries on the pages' hosts, domains and first path segments, by hashes of their names."""
    day = F.lit("2022-10-01").cast("date")
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    domains = hosts.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    prefixes = pages.select(F.concat(host_of(F.col("url")), F.lit("/"), F.regexp_extract(path_of(F.col("url")), r"^([^/]+)", 1)).alias("pattern"))
    prefixes = prefixes.where("pattern is not null and not pattern like '%/'").distinct()

    def listed(patterns: DataFrame, name: str, first: int) -> DataFrame:
        h = _hex(F.concat_ws(":", F.lit(name), F.col("pattern")), first)
        some = patterns.where(h % 2 == 0).select("pattern", h.alias("h"))
        added = some.select(F.lit(name).alias("list"), "pattern", F.date_add(day, F.col("h") % 500).alias("at"), F.lit("add").alias("action"))
        removed = some.where("h % 3 <> 0").select(F.lit(name).alias("list"), "pattern", F.date_add(day, F.col("h") % 500 + 100).alias("at"), F.lit("remove").alias("action"))
        again = some.where("h % 5 = 0").select(F.lit(name).alias("list"), "pattern", F.date_add(day, F.col("h") % 500 + 200).alias("at"), F.lit("add").alias("action"))
        return added.unionByName(removed).unionByName(again)

    return listed(domains, "spam", 1).unionByName(listed(hosts, "malware", 5)).unionByName(listed(prefixes, "allow", 9))


def _oracle_hex(text: str, first: int) -> str:
    return f"CAST(('0x' || substr(md5({text}), {first}, 4)) AS INTEGER)"


def _oracle_listed(table: str, name: str, first: int) -> str:
    h = _oracle_hex(f"'{name}:' || pattern", first)
    d = "DATE '2022-10-01'"
    return f"""
  SELECT '{name}' AS list, pattern, {d} + (h % 500) AS day, 'add' AS action FROM (SELECT pattern, {h} AS h FROM {table}) WHERE h % 2 = 0
  UNION ALL SELECT '{name}', pattern, {d} + (h % 500 + 100), 'remove' FROM (SELECT pattern, {h} AS h FROM {table}) WHERE h % 2 = 0 AND h % 3 <> 0
  UNION ALL SELECT '{name}', pattern, {d} + (h % 500 + 200), 'add' FROM (SELECT pattern, {h} AS h FROM {table}) WHERE h % 2 = 0 AND h % 5 = 0"""


ORACLE = rf"""
WITH c AS (SELECT page_id, url, DATE '2023-01-01' + ({_oracle_hex("CAST(page_id AS VARCHAR)", 1)} % 730) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM c WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(pattern, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM hosts WHERE regexp_extract(pattern, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
prefixes AS (SELECT DISTINCT host || '/' || regexp_extract(path, '^([^/]+)', 1) AS pattern FROM c WHERE host IS NOT NULL AND regexp_extract(path, '^([^/]+)', 1) <> ''),
entries AS ({_oracle_listed("domains", "spam", 1)}
  UNION ALL {_oracle_listed("hosts", "malware", 5)}
  UNION ALL {_oracle_listed("prefixes", "allow", 9)}),
state AS (SELECT list, pattern, day, max(action) AS action FROM entries GROUP BY ALL),
keys AS (SELECT DISTINCT page_id, url, fetched, unnest(list_concat(
      list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      CASE WHEN path <> '' THEN list_transform(generate_series(1, len(regexp_split_to_array(path, '/+'))), lambda i: host || '/' || array_to_string(regexp_split_to_array(path, '/+')[1:i], '/')) ELSE [] END)) AS key
    FROM c WHERE host IS NOT NULL),
last AS (SELECT k.page_id, k.url, k.fetched, s.list, s.pattern, arg_max(s.action, s.day) AS action
    FROM keys k JOIN state s ON s.pattern = k.key AND s.day <= k.fetched GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(pattern) DESC, (list = 'allow'), list, pattern) AS r FROM last WHERE action = 'add')
SELECT c.page_id, c.fetched, CASE WHEN b.list IS NULL THEN 'unlisted' WHEN b.list = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict, b.list, b.pattern
FROM c LEFT JOIN best b ON b.r = 1 AND b.page_id IS NOT DISTINCT FROM c.page_id AND b.url = c.url AND b.fetched = c.fetched
"""
