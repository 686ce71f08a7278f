"""A projection barrier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed before any later filter looks at them.

    Catalyst pushes a filter below the projection it reads from and evaluates the projected
    expressions a second time there; long parsing expressions then outgrow what the JVM compiles.
    A generator that unpacks one struct per row keeps the filter above, inside the same stage.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))))
