"""Column-level functions for normalising crawl records.

Every function returns a ``Column`` (or adds columns to a DataFrame) built
from Spark's own expressions, so the work stays inside whole-stage codegen;
no Python UDF is involved.  ``now`` and id expressions are parameters so a
batch uses one stamp and tests are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from crawlq.constants import ACCOUNT_URL_MARKER, DEFAULT_CRAWL_DEPTH, NULL_LITERALS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- defaults

def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each default only when the column is *absent* (a NULL stays NULL)."""
    extra = [expr.alias(name) for name, expr in defaults.items() if name not in df.columns]
    return df.select("*", *extra) if extra else df


def stable_id(*cols: Column | str) -> Column:
    """A UUID-shaped id derived from the given columns (SHA-256 of their text).

    Unlike a random UUID, it is the same when a task is retried after an
    executor loss, so a recomputed partition cannot change row ids.
    """
    parts = [F.coalesce(_c(c).cast("string"), F.lit("\u0000")) for c in cols]
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def random_id() -> Column:
    """A random UUID per row (``uuid()``)."""
    return F.expr("uuid()")


# ------------------------------------------------------------- URL and text

def account_from_url(url: Column | str, marker: str = ACCOUNT_URL_MARKER) -> Column:
    """The path token after the first ``marker`` segment, cut at ``?`` then ``#``.

    Trailing slashes are removed before splitting on ``/``; a URL without the
    marker, with nothing after it, NULL or empty gives NULL.
    """
    u = _c(url)
    parts = F.split(F.regexp_replace(u, "/+$", ""), "/")
    pos = F.array_position(parts, marker)
    tok = F.when(pos > 0, F.try_element_at(parts, (pos + 1).cast("int")))
    tok = F.substring_index(F.substring_index(tok, "?", 1), "#", 1)
    return F.when(u.isNotNull() & (u != ""), tok)


# Characters Python's ``str.strip()`` removes, derived from ``str.isspace``.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_text(col: Column | str) -> Column:
    """Python-style ``str.strip()``: leading/trailing Unicode whitespace removed."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def normalize_keyword(col: Column | str, suffix: str) -> Column:
    """I4: stripped keyword plus ``suffix``; NULL when NULL or blank."""
    s = strip_text(col)
    return F.when(s != "", F.concat(s, F.lit(suffix)))


def id_to_string(col: Column | str) -> Column:
    """The id as text; NULL stays NULL."""
    return _c(col).cast("string")


def nullify_literals(col: Column | str, literals: Sequence[str] = NULL_LITERALS) -> Column:
    """Text meaning "no value" ('None', 'null', 'undefined', '') becomes NULL."""
    c = _c(col)
    return F.when(c.isin(*literals), F.lit(None).cast(StringType())).otherwise(c)


def text_or_empty(col: Column | str) -> Column:
    """NULL becomes ``""``; anything else its text."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def depth_default(col: Column | str) -> Column:
    """Crawl depth as an integer; NULL becomes 1 (bad text fails under ANSI)."""
    return F.coalesce(_c(col).cast("long"), F.lit(DEFAULT_CRAWL_DEPTH).cast("long"))


# ------------------------------------------------------------------- arrays

def array_or_empty(col: Column | str, dtype: DataType | None = None) -> Column:
    """NULL (or, for JSON text, anything but a JSON array) becomes ``[]``.

    With ``dtype`` = the array type, a JSON text column is parsed; otherwise
    the column is already typed and only NULL is replaced.
    """
    c = _c(col)
    if dtype is None:
        return F.coalesce(c, F.array())
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, dtype))
    return F.coalesce(parsed, F.array().cast(dtype))


def compact_string_array(col: Column | str) -> Column:
    """I8: drop NULL elements, the rest as text."""
    return F.transform(F.filter(_c(col), lambda x: x.isNotNull()), lambda x: x.cast("string"))


def _struct_of_text(fields: Iterable[str]) -> StructType:
    return StructType([StructField(f, StringType()) for f in fields])


def normalize_struct_array(col: Column | str, fields: Sequence[str],
                           null_fields: Sequence[str] = (), json: bool = False,
                           present: Sequence[str] | None = None) -> Column:
    """Keep only record items; each becomes ``struct(fields...)`` where a
    missing, NULL or empty value is ``""``; other fields are dropped.

    ``null_fields`` are appended as NULL (declared by the table schema but not
    produced by the normaliser).  With ``json=True`` the column is JSON text:
    items that are not JSON objects are skipped.  NULL (or non-array) input
    gives ``[]``.  For typed input, ``present`` lists the fields the element
    struct has (the others read as missing).
    """
    c = _c(col)
    have = set(fields) if json or present is None else set(present)
    if json:
        raw = F.coalesce(F.when(F.ltrim(c).startswith("["),
                                F.from_json(c, ArrayType(StringType()))),
                         F.array().cast(ArrayType(StringType())))
        objs = F.filter(raw, lambda x: F.ltrim(x).startswith("{"))
        items = F.transform(objs, lambda x: F.from_json(x, _struct_of_text(fields)))
    else:
        items = F.coalesce(c, F.array())
    items = F.filter(items, lambda x: x.isNotNull())

    def clean(x: Column) -> Column:
        vals = [(F.coalesce(x.getField(f).cast("string"), F.lit("")) if f in have
                 else F.lit("")).alias(f) for f in fields]
        nulls = [F.lit(None).cast("string").alias(f) for f in null_fields]
        return F.struct(*vals, *nulls)

    return F.transform(items, clean)


# --------------------------------------------------------------------- text

def flatten_about(col: Column | str) -> Column:
    """Free-form ``about`` as text.

    NULL -> ``""``; a JSON array -> its items joined by one space (``[]`` ->
    ``""``, a null item prints as ``None``); a JSON object -> its JSON text (``{}`` -> ``""``); other text
    as is.  (The original printed objects with Python's repr; JSON text is
    kept instead.)
    """
    c = _c(col)
    t = F.ltrim(c)
    arr = F.from_json(c, ArrayType(StringType()))
    return (F.when(c.isNull(), F.lit(""))
            .when(t.startswith("[") & arr.isNotNull(), F.array_join(arr, " ", "None"))
            .when(t.startswith("{") & c.rlike(r"^\s*\{\s*\}\s*$"), F.lit(""))
            .otherwise(c))


# --------------------------------------------------------------- timestamps

def iso_format(ts: Column | str, utc_suffix: bool = True) -> Column:
    """ISO-8601 text of a timestamp (microseconds only when non-zero),
    with ``+00:00`` for UTC instants; NULL stays NULL.

    A zoned timestamp is written as its UTC wall time whatever the session's
    zone is; a timestamp without a zone is taken as UTC wall time already.
    """
    t = _c(ts)
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(t.cast("timestamp")),
                          F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    wall = F.when(F.typeof(t) == "timestamp", utc).otherwise(t.cast("timestamp_ntz")).cast("string")
    base = F.translate(F.substring(wall, 1, 19), " ", "T")
    micros = F.substring(wall, 21, 6)
    text = F.when(micros == "", base).otherwise(F.concat(base, F.lit("."), F.rpad(micros, 6, "0")))
    return F.concat(text, F.lit("+00:00")) if utc_suffix else text


def is_iso_time(text: Column | str) -> Column:
    """Whether the text is an ISO date, or date and time, that exists.

    Accepted: ``YYYY-MM-DD``, optionally followed by ``T`` or one space and
    ``HH[:MM[:SS[.f]]]`` with up to six decimals and ``Z`` or ``+HH:MM``.
    Basic and week-date forms are not.
    """
    t = _c(text)
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    # Hours alone get minutes, which the timestamp parser needs.
    whole = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|Z|[+-])", "$1:00")
    return shape & F.try_to_timestamp(whole).isNotNull()


def post_time_iso(posts: Column | str, now: Column, null_time: str = "keep") -> Column:
    """In ``posts[]`` keep ISO ``time`` text; other text becomes ``now``
    as ISO text.  A NULL time is left alone (``null_time="keep"``) or set to
    ``now`` (``"now"``)."""
    now_text = iso_format(now)

    def fix(p: Column) -> Column:
        t = p.getField("time")
        bad = t.isNotNull() & ~is_iso_time(t)
        if null_time == "now":
            bad = bad | t.isNull()
        return p.withField("time", F.when(bad, now_text).otherwise(t))

    return F.transform(_c(posts), fix)


def drop_null_items(col: Column, dtype: DataType) -> Column:
    """NULL items removed from every array inside ``col``, at any depth
    (arrays of structs, structs holding arrays, ...); NULL values stay NULL."""
    if isinstance(dtype, ArrayType):
        kept = F.filter(col, lambda x: x.isNotNull())
        if isinstance(dtype.elementType, (ArrayType, StructType)):
            return F.transform(kept, lambda x: drop_null_items(x, dtype.elementType))
        return kept
    if isinstance(dtype, StructType) and any(
            isinstance(f.dataType, (ArrayType, StructType)) for f in dtype.fields):
        fields = [drop_null_items(col.getField(f.name), f.dataType).alias(f.name)
                  for f in dtype.fields]
        return F.when(col.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    return col


def json_ready(df: DataFrame, ts_format: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") -> DataFrame:
    """Each row as JSON text (``json``): timestamps as ISO text, NULL
    fields kept, NULL items dropped from arrays at any depth."""
    cols = [drop_null_items(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    opts = {"timestampFormat": ts_format, "timestampNTZFormat": ts_format.replace("XXX", ""),
            "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*cols), opts).alias("json"))


# --------------------------------------------------------------- validation

REQUIRED_BY_TYPE = {
    "urls": ("id", "created_at", "updated_at", "url", "status"),
    "urls_v1": ("id", "created_at", "updated_at", "url", "status"),
}
REQUIRED_DEFAULT = ("id", "created_at", "updated_at")


def required_fields_ok(table_type: str, columns: Iterable[str] | None = None) -> Column:
    """I16: every required column of the table type is non-NULL.

    A required column that the row does not have at all fails the check.
    """
    need = REQUIRED_BY_TYPE.get(table_type, REQUIRED_DEFAULT)
    have = None if columns is None else set(columns)
    ok = F.lit(True)
    for c in need:
        ok = ok & (F.col(c).isNotNull() if have is None or c in have else F.lit(False))
    return ok
