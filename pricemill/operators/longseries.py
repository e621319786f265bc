"""Windows over series too long for one task.

A window partitioned by series puts a whole series into one task. That is fine for daily bars
(a series has one row per day) but not for ticks, where one series may hold a third of all
rows. Here every row gets its position in the series and a chunk of ``chunk_rows``
consecutive positions. Each chunk also receives copies of the ``halo`` rows before it, so a
window over (series, chunk) sees everything a frame of ``halo`` preceding rows needs; the
copies are dropped afterwards.

Positions come without a global sort. Each series is cut into buckets, ranges of its order key
of about ``chunk_rows`` rows: the width follows from the number of rows and the span of the
series' keys, so keys far apart do not make a bucket a row, and where rows lie closer than
elsewhere a bucket is cut again, until none has more than twice as many. The order key is an integer
(or a date or timestamp), unique per series, so that ends. Exact counts of the buckets, a table
of about rows / ``chunk_rows`` rows, are stored; their running sum gives each bucket its first
position and a sort inside the bucket the rest. Nothing is sampled, so a lost executor
recomputes the same chunks.

The number of tasks of both shuffles follows from the counted rows (``TASK_ROWS``), so what a task
sorts and keeps for its windows does not grow with the input.

Window keys start with the number, not the series: it sorts by an eight-byte prefix, while
rows of one long series would all compare equal by theirs.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.functions.windows import columns
from pricemill.operators.joins import join_groups
from pricemill.session import scratch_path

CHUNK = "_chunk"
HALO = "_halo"
POSITION = "_position"
_BUCKET = "_bucket"
_OFFSET = "_offset"
_RANK = "_rank"
_IS_ROW = "_is_row"
_WIDTH = "_width"

DEFAULT_CHUNK_ROWS = 1 << 16
# A bucket with more rows than this many chunks is cut again, into at most so many parts.
_MOST_CHUNKS = 2
_MOST_PARTS = 1024
# Rows a task gets to sort and to keep for its windows, about; their number follows from the rows.
TASK_ROWS = 1 << 19


def _floor_div(expression, divisor):
    """Whole-number floor division (``/`` would go through doubles and lose long keys)."""
    return f"(({expression}) - pmod({expression}, {divisor}L)) div {divisor}L"


def whole_number(df, order):
    """SQL of the order key (an integer, date or timestamp) as a 64-bit integer."""
    data_type = df.schema[order].dataType
    key = f"CAST(`{order}` AS BIGINT)"
    if isinstance(data_type, T.DateType):
        key = f"CAST(unix_date(`{order}`) AS BIGINT)"
    elif isinstance(data_type, T.TimestampType):
        key = f"unix_micros(`{order}`)"
    elif isinstance(data_type, T.TimestampNTZType):
        # Field by field: a cast to TIMESTAMP would depend on the session's time zone.
        key = (
            f"unix_date(CAST(`{order}` AS DATE)) * 86400000000L + hour(`{order}`) * 3600000000L"
            f" + minute(`{order}`) * 60000000L"
            f" + CAST(extract(SECOND FROM `{order}`) * 1000000 AS BIGINT)"
        )
    return key


def _stored(frame):
    """A small table in the scratch folder, so that it is computed once."""
    path = scratch_path(frame.sparkSession, "buckets")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _width(parts):
    """SQL of the key width that cuts ``_low`` to ``_high`` into ``parts`` ranges."""
    span = "CAST(_high AS DECIMAL(20, 0)) - CAST(_low AS DECIMAL(20, 0)) + 1"
    width = f"CAST(ceil(({span}) / CAST({parts} AS DECIMAL(20, 0))) AS DECIMAL(20, 0))"
    return f"CAST(greatest(least({width}, {(1 << 63) - 1}BD), 1BD) AS BIGINT)"


def _range_start(key, width):
    """SQL of the smallest key of a key's range, where ranges begin at multiples of the width."""
    return f"coalesce(try_subtract({key}, pmod({key}, {width})), {-(1 << 63)}L)"


def buckets(df, series, order, chunk_rows, *summary):
    """(rows with their bucket, one stored row per bucket).

    A bucket is named by the first key of its range. Its row has the number of rows ``_n`` and
    whatever ``summary`` adds up.
    """
    key = whole_number(df, order)
    span = [F.min(F.expr(key)).alias("_low"), F.max(F.expr(key)).alias("_high"),
            F.count(F.lit(1)).alias("_n")]
    widths = df.groupBy(*series).agg(*span).select(
        *series, F.expr(_width(f"ceil(_n / {chunk_rows})")).alias(_WIDTH)
    )
    bucketed = join_groups(df, _stored(widths), series).withColumn(
        _BUCKET, F.expr(_range_start(key, _WIDTH))
    ).drop(_WIDTH)
    while True:
        sizes = _stored(bucketed.groupBy(*series, _BUCKET).agg(*span, *summary))
        large = sizes.where(f"_n > {_MOST_CHUNKS * chunk_rows} AND _high > _low")
        if large.isEmpty():
            return bucketed, sizes
        parts = f"greatest(2, least({_MOST_PARTS}, ceil(_n / {chunk_rows})))"
        finer = large.select(*series, _BUCKET, F.expr(_width(parts)).alias(_WIDTH))
        cut = F.greatest(F.col(_BUCKET), F.expr(_range_start(key, _WIDTH)))
        bucketed = join_groups(bucketed, finer, [*series, _BUCKET], "left").withColumn(
            _BUCKET, F.when(F.col(_WIDTH).isNull(), F.col(_BUCKET)).otherwise(cut)
        ).drop(_WIDTH)


def _running(partition, order, last):
    return (
        Window.partitionBy(*partition).orderBy(*columns(order))
        .rowsBetween(Window.unboundedPreceding, last)
    )


def with_position(df, series, order, chunk_rows=DEFAULT_CHUNK_ROWS):
    """Add the zero-based position of each row in its series."""
    return _positioned(df, columns(series), order, chunk_rows)[0].drop(_BUCKET, _RANK)


def tasks_for(sizes, task_rows=None):
    """The number of tasks for the rows of the stored buckets, so that none grows with the input.

    Never fewer than the cores there are.
    """
    rows = sizes.agg(F.sum("_n")).first()[0] or 0
    return max(sizes.sparkSession.sparkContext.defaultParallelism, -(-rows // (task_rows or TASK_ROWS)))


def _positioned(df, series, order, chunk_rows, counted=None):
    """(positions and buckets, tasks); with ``counted``, only rows that have this value advance."""
    size = F.count(F.lit(1) if counted is None else counted)
    bucketed, sizes = buckets(df, series, order, chunk_rows, size.alias("_rows"))
    before = _running(series, _BUCKET, 0)
    offsets = sizes.select(
        *series, _BUCKET,
        (F.sum("_rows").over(before) - F.col("_rows")).alias(_OFFSET),
        F.row_number().over(Window.partitionBy(*series).orderBy(_BUCKET)).alias(_RANK),
    )
    tasks = tasks_for(sizes)
    marked = _with_markers(bucketed, offsets).repartition(tasks, _BUCKET, *series)
    in_bucket = _running([_BUCKET, *series], [_IS_ROW, order], 0)
    seen = F.count(F.when(F.col(_IS_ROW), F.lit(1)) if counted is None else counted)
    positioned = marked.withColumns(
        {
            POSITION: F.first(_OFFSET).over(in_bucket) + seen.over(in_bucket) - F.lit(1),
            _RANK: F.first(_RANK).over(in_bucket),
        }
    ).filter(_IS_ROW).drop(_OFFSET, _IS_ROW)
    return positioned, tasks


def _with_markers(bucketed, per_bucket):
    """Add one row per bucket, sorted before its other rows, that brings in its summary.

    Rows and summaries meet in the shuffle the bucket's window needs anyway; a join would
    have to move the rows once more.
    """
    return bucketed.withColumn(_IS_ROW, F.lit(True)).unionByName(
        per_bucket.withColumn(_IS_ROW, F.lit(False)), allowMissingColumns=True
    )


def with_chunks(df, series, order, halo, chunk_rows=DEFAULT_CHUNK_ROWS, counted=None):
    """Add position, chunk and halo flag; rows near a chunk's end are copied into the next.

    With ``counted``, chunks and halo are made of the rows that have this value; the others
    belong to no window and are put into negative chunks, one per bucket. Partitioned by
    chunk, which also serves windows over parts of a chunk.
    """
    rows = max(chunk_rows, halo + 1)
    own = _floor_div(POSITION, rows)
    last = _floor_div(f"{POSITION} + {halo}", rows)
    if counted is not None:
        aside = f"-CAST({_RANK} AS BIGINT)"
        own, last = (f"IF(`{counted}` IS NULL, {aside}, {e})" for e in (own, last))
    positioned, tasks = _positioned(df, columns(series), order, chunk_rows, counted)
    return (
        positioned.withColumn("_own", F.expr(own))
        .withColumn(CHUNK, F.explode(F.sequence("_own", F.expr(last))))
        .withColumn(HALO, F.col(CHUNK) != F.col("_own"))
        .drop("_own", _BUCKET, _RANK)
        .repartition(tasks, *columns(series), CHUNK)
    )


def over_chunks(df, series, order, halo, chunk_rows, build, counted=None):
    """Run ``build(frame, partition_columns)`` chunk by chunk and drop the halo rows."""
    chunked = with_chunks(df, series, order, halo, chunk_rows, counted)
    built = build(chunked, [CHUNK, *columns(series)])
    return built.filter(~F.col(HALO)).drop(CHUNK, HALO, POSITION)


def forward_fill(df, series, order, values, chunk_rows=DEFAULT_CHUNK_ROWS):
    """Fill NULLs with the last value before them, for series of any length.

    A fill can reach back without limit, so a halo does not do. Each bucket's last values are
    stored with its size; what a bucket starts from is the last one of those before it.
    """
    series = columns(series)
    bucketed, ends = buckets(
        df, series, order, chunk_rows, *[_last_known(v, order).alias(f"_end_{v}") for v in values]
    )
    before = _running(series, _BUCKET, -1)
    carried = ends.select(
        *series, _BUCKET,
        *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(v) for v in values],
    )
    inside = _running([_BUCKET, *series], [_IS_ROW, order], 0)
    marked = _with_markers(bucketed, carried).repartition(tasks_for(ends), _BUCKET, *series)
    return marked.select(
        *[
            F.last(v, ignorenulls=True).over(inside).alias(v) if v in values else F.col(v)
            for v in (*df.columns, _IS_ROW)
        ]
    ).filter(_IS_ROW).drop(_IS_ROW)


def _last_known(value, order):
    """The value at the largest order key that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
