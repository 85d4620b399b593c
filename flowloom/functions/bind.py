"""Binding a value to a column of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column) -> Column:
    """The value, computed once for each row where this column stands in select or withColumn.

    The optimiser moves a filter below projections, joins and groupings by writing out what its columns stand for, again and again; generated code
    can outgrow what the JVM compiles. It moves none below explode.
    """
    return F.explode(F.array(value))
