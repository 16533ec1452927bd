"""Training samples of bounded size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a training task reads at most.
MAX_BYTES = 48 << 20
#: One text may take this share of them; longer ones are left out of training.
PER_TEXT = 64


def within(sample: DataFrame, order: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``sample`` from the start of ``order`` on, while their ``text`` fits in ``max_bytes``.

    ``sample`` is stored, has a limited number of rows, and ``order`` names each of them. Only sizes are
    ranked; whole texts are kept or left out. Null texts have size 0.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        sample.select(*order, size.alias("_size")).where(F.col("_size") <= max_bytes // PER_TEXT)
        .withColumn("_sum", F.sum("_size").over(upto)).where(F.col("_sum") <= max_bytes))
    return sample.join(F.broadcast(kept.select(*order)), order, "left_semi")
