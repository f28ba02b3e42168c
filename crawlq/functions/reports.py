"""Error-report rendering (I17-I19): subject, detail map and text body.

All three are column expressions, so a table of error reports is rendered
in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from crawlq.constants import (
    ERROR_CONTEXT_RULE, ERROR_DETAILS_RULE, ERROR_REPORT_FOOTER, ERROR_REPORT_TITLE_SUFFIX,
    ERROR_RULE_EXTRA, ERROR_SUBJECT_SUFFIX, ERROR_TIMESTAMP_FORMAT,
)
from crawlq.functions.columns import strip_text

TEXT_MAP = MapType(StringType(), StringType())


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def _given(c: Column) -> Column:
    """Python truthiness of an optional text: not NULL and not empty."""
    return c.isNotNull() & (c != "")


def title_case(c: Column) -> Column:
    """Words capitalised (``initcap``; splits on spaces only)."""
    return F.initcap(c)


def error_subject(title: Column | str, platform: Column | str,
                  extension_id: Column | str) -> Column:
    """``<title> Error[ - <Platform>][ (<extension_id>)]``."""
    t, p, e = _c(title), _c(platform), _c(extension_id)
    return F.concat(
        t, F.lit(ERROR_SUBJECT_SUFFIX),
        F.when(_given(p), F.concat(F.lit(" - "), title_case(p))).otherwise(F.lit("")),
        F.when(_given(e), F.concat(F.lit(" ("), e, F.lit(")"))).otherwise(F.lit("")),
    )


def context_map(json_text: Column | str) -> Column:
    """Additional context given as JSON object text -> ``map<string,string>``."""
    return F.from_json(_c(json_text), TEXT_MAP)


def error_details(error_type: Column | str, url: Column | str, stack_trace: Column | str,
                  context: Column | str) -> Column:
    """Ordered detail map.

    ``error_type``, ``url`` and ``stack_trace`` are added when non-empty, then
    the additional context: a context key that repeats one of those replaces
    its value in place (dict-update order), the others follow in context
    order.  No session setting is needed because no duplicate key is built.
    """
    ctx = F.coalesce(_c(context), F.create_map().cast(TEXT_MAP))
    base_entries = F.array_compact(F.array(*[
        F.when(_given(_c(v)), F.struct(F.lit(k).alias("key"), _c(v).alias("value")))
        for k, v in (("error_type", error_type), ("url", url), ("stack_trace", stack_trace))
    ]))
    base = F.map_from_entries(base_entries)
    base = F.transform_values(
        base, lambda k, v: F.when(F.map_contains_key(ctx, k), F.element_at(ctx, k)).otherwise(v))
    rest = F.map_filter(ctx, lambda k, v: ~F.map_contains_key(base, k))
    return F.map_concat(base, rest)


def error_text(title: Column | str, error_message: Column | str,
               extension_id: Column | str, platform: Column | str,
               details: Column, stamp: Column, user_agent: Column | str | None = None) -> Column:
    """Plain-text body of an error report (outer whitespace stripped).

    Layout: title line, ``=`` rule of ``len(title) + 13``, the message, a
    Details block (timestamp, optional platform, extension id and user agent), an
    optional Additional Information block with one ``Key Name: value`` line
    per detail (``_`` -> space, words capitalised, NULL -> ``None``), and a
    fixed footer.  ``stamp`` is the report time.
    """
    t, m, e, p = _c(title), _c(error_message), _c(extension_id), _c(platform)
    agent = F.lit(None).cast("string") if user_agent is None else _c(user_agent)
    lines = F.transform(
        F.map_entries(details),
        lambda x: F.concat(title_case(F.regexp_replace(x["key"], "_", " ")), F.lit(": "),
                           F.coalesce(x["value"], F.lit("None")), F.lit("\n")))
    extra = F.when(
        F.size(details) > 0,
        F.concat(F.lit("\nAdditional Information:\n" + ERROR_CONTEXT_RULE + "\n"),
                 F.array_join(lines, ""))).otherwise(F.lit(""))
    body = F.concat(
        F.lit("\n"), t, F.lit(ERROR_REPORT_TITLE_SUFFIX + "\n"),
        F.repeat(F.lit("="), F.length(t) + ERROR_RULE_EXTRA), F.lit("\n\nError Message:\n"),
        m, F.lit("\n\nDetails:\n" + ERROR_DETAILS_RULE + "\nTimestamp: "),
        F.date_format(stamp, ERROR_TIMESTAMP_FORMAT), F.lit("\n"),
        F.when(_given(p), F.concat(F.lit("Platform: "), title_case(p), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(_given(e), F.concat(F.lit("Extension ID: "), e, F.lit("\n"))).otherwise(F.lit("")),
        F.when(_given(agent), F.concat(F.lit("User Agent: "), agent, F.lit("\n"))).otherwise(F.lit("")),
        extra,
        F.lit("\n" + ERROR_REPORT_FOOTER + "\n        "),
    )
    return strip_text(body)
