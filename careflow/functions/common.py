"""Column helpers built only from Spark's built-in expressions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen;
nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonblank_or(c, default: str) -> Column:
    """``x or default`` of Python: NULL and '' both take the default."""
    c = col_or(c)
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def is_blank(c) -> Column:
    """NULL, empty or whitespace only (JavaScript ``!s.trim()``)."""
    c = col_or(c)
    return c.isNull() | F.regexp_like(c, F.lit(r"^\s*$"))


_END = "#end of text#"


def whole_json(c) -> Column:
    """The text as a variant if all of it is one JSON value, else NULL.

    A JSON parser reads one value and ignores what follows; wrapped in a list
    before an end mark, such text no longer parses.
    """
    v = F.try_parse_json(F.concat(F.lit("["), col_or(c), F.lit(f',"{_END}"]')))
    return F.when(F.try_variant_get(v, "$[1]", "string") == _END, F.try_variant_get(v, "$[0]", "variant"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once.

    A one-row generator: what is built upon the columns is not merged with the
    expressions behind them, so a costly one is not evaluated again in every
    place that uses it, nor in a filter pushed below it.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the session's cores where it has fewer files than cores.

    For work that is heavy for each row: a small file is one task. Tables of
    many files pass as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def with_whole_json(df: DataFrame, c: str, out: str) -> DataFrame:
    """``df`` with ``whole_json(c)`` as a column, the text parsed once."""
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit(f',"{_END}"]')))
    df = settled(df.withColumn("__listed", listed))
    whole = F.try_variant_get("__listed", "$[1]", "string") == _END
    return settled(df.withColumn(out, F.when(whole, F.try_variant_get("__listed", "$[0]", "variant"))).drop("__listed"))


def json_string(c) -> Column:
    """One string value as a JSON string literal (escaped, quoted); NULL -> null."""
    return F.regexp_extract(F.to_json(F.array(col_or(c))), r"^\[(.*)\]$", 1)


def json_list_text(c) -> Column:
    """A list as ``json.dumps`` writes it: ``["a", "b"]`` (comma + blank)."""
    c = col_or(c)
    items = F.transform(c, json_string)
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def iso_text(c) -> Column:
    """``datetime.isoformat()`` of a wall-clock time (no fraction when 0).

    Made from the fields of the zone-less value, so the session time zone
    (and its missing or doubled hours) plays no part.
    """
    text = col_or(c).cast("timestamp_ntz").cast("string")
    fraction = F.concat(F.lit("."), F.rpad(F.substring_index(text, ".", -1), 6, "0"))
    return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")),
                    F.when(F.contains(text, F.lit(".")), fraction).otherwise(F.lit("")))


def make_id(prefix: str, key) -> Column:
    """Deterministic identifier: prefix + the whole SHA-256 of the key (64 hex digits).

    Deterministic so that a retried task produces the same id; whole, so that
    ids stay unique at any number of rows.
    """
    return F.concat(F.lit(prefix), F.upper(F.sha2(col_or(key).cast("string"), 256)))


def latest_by(df: DataFrame, key: str | list[str], order_cols: list[str],
              value_cols: list[str]) -> DataFrame:
    """Latest row per key by ``order_cols`` (descending, last is tie-break).

    ``max_by`` over a struct is a hash aggregate with a map-side partial step,
    so a key holding a third of all rows is reduced to one row per input
    partition before the shuffle; no sort of the group is needed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in order_cols + [v for v in value_cols if v not in order_cols]])
    out = df.groupBy(*keys).agg(F.max_by(payload, order).alias("__latest"))
    return out.select(*keys, *[F.col("__latest." + c).alias(c)
                               for c in order_cols + [v for v in value_cols if v not in order_cols]])


def literal_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed dimension (vocabulary) as a DataFrame; size known."""
    return spark.createDataFrame(rows, schema)


#: Ids of one leaf range and of one middle range (powers of two), where times are equal.
LEAF_IDS, MIDDLE_IDS = 10, 20
_NONE = -(1 << 62)


def _name(c: str) -> str:
    return f"`{c}`"


def _instant(kind: str, c: str) -> tuple[str, int] | None:
    """A whole number that is equal for equal values and rises with the column, and how
    many of them make a stretch: a minute of microseconds, 60 days, 60 numbers. None for
    other kinds of columns.

    A zone-less time is read by its fields: as an instant of the session's zone,
    a missing hour would change the order.
    """
    days = f"date_diff({c}, DATE'1970-01-01')"
    if kind == "timestamp":
        return f"unix_micros({c})", 60_000_000
    if kind == "timestamp_ntz":
        return f"(({days} * 24L + hour({c})) * 60 + minute({c})) * 60000000L + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)", 60_000_000
    if kind == "date":
        return f"CAST({days} AS BIGINT)", 60
    if kind in ("long", "integer", "short", "byte"):
        return f"CAST({c} AS BIGINT)", 60
    return None


def placed(df: DataFrame, ts_col: str, tie_col: str) -> DataFrame:
    """``df`` with ranges that rise with (ts, tie): ``__bucket_minute``, in it
    ``__bucket_middle`` (an instant and 2**20 ids), in it ``__bucket`` (2**10 ids).

    They are computed from the row alone, so nothing is sampled or sorted to place
    a row, and their number follows the data: a busy minute has as many as it has
    instants, a single hot instant as many as it has thousands of ids. NULL times
    come first. A tie column that is no integer does not cut an instant; a time that
    is neither time nor integer (text) leaves one range, which is right, but not spread.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    at, stretch = _instant(kinds[ts_col], _name(ts_col)) or ("0L", 1)
    cut = at != "0L" and kinds[tie_col] in ("long", "integer", "short", "byte")
    at = f"coalesce({at}, {_NONE}L)"
    tie = f"coalesce(CAST({_name(tie_col)} AS BIGINT), {_NONE}L)" if cut else "0L"
    ids = lambda bits: f"struct({at} AS instant, shiftright({tie}, {bits}) AS ids)"
    return df.selectExpr("*", f"({at} - pmod({at}, {stretch}L)) AS __bucket_minute",
                         f"{ids(MIDDLE_IDS)} AS __bucket_middle", f"{ids(LEAF_IDS)} AS __bucket")


def _running(weight: str, parent: list[str], order: str, last: str = "1 PRECEDING") -> str:
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    return f"coalesce(sum({weight}) OVER ({by}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {last}), 0L)"


def prefix_offsets(counted: DataFrame, group_cols: list[str]) -> DataFrame:
    """Group, ``__bucket`` and ``__off``: the weights (``__w``) of all ranges before it.

    A prefix scan by levels: weights are added up per leaf, middle range and minute, and
    each level's running sum is a window within its parent only (minutes of a group, 5
    million in ten years; middle ranges of a minute; leaves of a middle range), over sums,
    never over rows.
    """
    levels, groups = ["__bucket_minute", "__bucket_middle", "__bucket"], [_name(c) for c in group_cols]
    sums, out = counted.groupBy(*group_cols, *levels).agg(F.sum("__w").alias("__n")), None
    for k, level in enumerate(levels):
        own = sums if level == "__bucket" else sums.groupBy(*group_cols, *levels[:k + 1]).agg(F.sum("__n").alias("__n"))
        parent = groups + levels[k - 1:k]
        if out is None:
            out = own.selectExpr(*groups, level, f"{_running('__n', parent, level)} AS __off")
            continue
        own = own.selectExpr(*parent, level, f"{_running('__n', parent, level)} AS __off").alias("own")
        # null-safe: a NULL group key is a group of its own, not a lost row
        same = " AND ".join(f"own.{c} <=> above.{c}" for c in parent)
        out = own.join(out.alias("above"), F.expr(same)).selectExpr(*[f"own.{c}" for c in groups], f"own.{level}", "own.__off + above.__off AS __off")
    return out


def prefix_position(df: DataFrame, group_cols: list[str], ts_col: str, tie_col: str, weight_col: str | None = None,
                    inclusive: bool = True, out: str = "position", counted: DataFrame | None = None) -> DataFrame:
    """Running count (or running sum of ``weight_col``) in (ts, tie) order per group.

    A plain ``row_number() over (partition by group order by ts)`` puts a whole
    group in one task; a group holding a third of all rows (or, with no group
    columns, the whole table) would then sort in a single task. Instead rows are
    placed into small ranges (``placed``), the ranges' sums are scanned by levels
    (``prefix_offsets``), and rows are ranked within their range only, from the
    offset that is joined in. No range is bound to hold a share of the table.

    ``counted``: a cheaper frame to take the sums from, which holds every row of ``df``
    and beside them rows of weight 0 only (default: ``df`` itself, whose few columns
    for this are then read a second time). ``inclusive`` counts the row itself (a
    1-based position); otherwise only rows strictly before it. NULL times come first.
    Building the plan starts no job.
    """
    weight = f"CAST({_name(weight_col)} AS BIGINT) AS __w" if weight_col else "1L AS __w"
    base = placed(df, ts_col, tie_col).selectExpr("*", weight)
    sums = base if counted is None else placed(counted, ts_col, tie_col).selectExpr("*", weight)
    keys = [*[_name(c) for c in group_cols], "__bucket"]
    same = " AND ".join(f"own.{c} <=> offsets.{c}" for c in keys)
    joined = base.alias("own").join(prefix_offsets(sums, group_cols).alias("offsets"), F.expr(same))
    joined = joined.selectExpr("own.*", "offsets.__off")
    within = _running("__w", keys, f"{_name(ts_col)}, {_name(tie_col)}", "CURRENT ROW" if inclusive else "1 PRECEDING")
    return joined.selectExpr(*[_name(c) for c in df.columns], f"CAST(__off + {within} AS BIGINT) AS {_name(out)}")
