"""Translation of a stream of matrix cells: it is linear, so running sums of translated cells are enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.operators.correspondence import Correspondence
from odweave.operators.translate import clean, common_type


def stream_translation(cells: DataFrame, lookup: Correspondence, columns: Correspondence | None = None, value: str = "value", at: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sums by target zones of a streaming long matrix, to be written in update mode.

    The lookups are static, so the joins keep no state. With a time column, sums are by window and their state
    goes once the watermark has passed.
    """
    other = columns or lookup
    kinds = [common_type(cells, c, x.table, x.source) for c, x in (("origin", lookup), ("destination", other))]
    rows = lookup.pairs("origin", "_row", "_f").withColumn("origin", F.col("origin").cast(kinds[0]))
    cols = other.pairs("destination", "_col", "_g").withColumn("destination", F.col("destination").cast(kinds[1]))
    cells = cells.withColumns({c: F.col(c).cast(k) for c, k in zip(("origin", "destination"), kinds, strict=True)})
    moved = cells.join(rows, "origin").join(cols, "destination").withColumn("_v", clean(value) * F.col("_f") * F.col("_g"))
    keys = [F.col("_row").alias("origin"), F.col("_col").alias("destination")]
    if at:
        moved, keys = moved.withWatermark(at, late), [F.window(at, window).alias("window"), *keys]
    return moved.groupBy(*keys).agg(F.sum("_v").alias(value))
