"""What a load changes: the rows it touches, the rows these depend on, and the partitions of both.

A refresh begins with the changed rows. Each needs some rows ahead of it in its series (a price
change needs one, RSI fourteen), and as many behind it depend on it. Partitions (months or years)
are few, so the list of those to read is a literal, and prunes the scan: history that no change can
reach is not read. Of the changed rows only the partitions reach the driver.
"""

from pyspark.sql import functions as F

from pricemill.functions.windows import columns, ordered


def values(rows, partition):
    """The partitions there are, in order, NULL left out; reads no data column of a stored table."""
    found = rows.select(partition).distinct().collect()
    return sorted(row[0] for row in found if row[0] is not None)


def partitions_to_read(rows, changed, series, order, partition, before, after):
    """Partitions with the changed rows and the ``before`` and ``after`` rows around them.

    ``rows`` and ``changed`` have the series, the order and the partition. Neighbouring partitions
    are added to both sides until every series has its rows there, or has no more.
    """
    names = columns(series)
    bounds = changed.groupBy(*names, partition).agg(
        F.min(order).alias("_first"), F.max(order).alias("_last")
    )
    starts = values(bounds, partition)
    known = sorted(set(values(rows, partition)) | set(starts))
    place = {value: i for i, value in enumerate(known)}
    back = forward = 1

    def reach(start):
        i = place[start]
        return known[max(0, i - back)], known[min(len(known) - 1, i + forward)]

    while starts:
        spans = [(start, *reach(start)) for start in starts]
        wanted = [v for v in known if any(low <= v <= high for _, low, high in spans)]
        if len(wanted) == len(known):
            return wanted
        lacking = _lacking(rows, bounds, spans, names, order, partition, wanted, before, after)
        if not any(lacking):
            return wanted
        back, forward = back * (1 + lacking[0]), forward * (1 + lacking[1])
    return []


def _lacking(rows, bounds, spans, names, order, partition, wanted, before, after):
    """Whether some series has too few rows in its span though it has more outside: (back, forward)."""
    kind = rows.schema[partition].dataType.simpleString()
    spark = rows.sparkSession
    reach = spark.createDataFrame(spans, f"`{partition}` {kind}, _low {kind}, _high {kind}")
    spanned = bounds.join(reach, partition).withColumnRenamed(partition, "_start")
    seen = rows.where(F.col(partition).isin(wanted)).select(*names, order, partition).distinct()
    inside = F.col(partition).between(F.col("_low"), F.col("_high"))
    counts = spanned.join(seen, names, "left").groupBy(*names, "_start", "_low", "_high").agg(
        F.count(F.when(inside & (F.col(order) < F.col("_first")), 1)).alias("_before"),
        F.count(F.when(inside & (F.col(order) > F.col("_last")), 1)).alias("_after"),
    )
    short = counts.where((F.col("_before") < before) | (F.col("_after") < after))
    outside = rows.where(~F.col(partition).isin(wanted)).select(*names, partition).distinct()
    found = short.join(outside, names).agg(
        F.max((F.col("_before") < before) & (F.col(partition) < F.col("_low"))),
        F.max((F.col("_after") < after) & (F.col(partition) > F.col("_high"))),
    ).first()
    return bool(found[0]), bool(found[1])


def flag_reached(rows, touched, series, order, after):
    """Rows with a boolean ``reached``: themselves touched, or among the ``after`` rows behind one.

    ``touched`` is a condition on the row.
    """
    window = ordered(series, order).rowsBetween(-after, 0)
    return rows.withColumn("reached", F.max(F.coalesce(touched, F.lit(False))).over(window))
