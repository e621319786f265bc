"""Window helpers. Every window is partitioned; none runs over a whole table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.functions.scalars import as_column


def columns(names):
    return [names] if isinstance(names, str) else list(names)


def ordered(partition, order):
    return Window.partitionBy(*columns(partition)).orderBy(*columns(order))


def trailing(partition, order, rows):
    """The current row and the ``rows - 1`` before it."""
    return ordered(partition, order).rowsBetween(-(rows - 1), Window.currentRow)


def change_from_previous(column, window):
    return as_column(column) - F.lag(as_column(column)).over(window)


def forward_filled(column, window):
    """The value, or the last one before it that is not NULL."""
    return F.last(as_column(column), ignorenulls=True).over(window)
