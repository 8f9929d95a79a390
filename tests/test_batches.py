"""Bytes of the Arrow batches that kernels get."""

import pyarrow as pa
from pyspark.sql import functions as F

from knowspan.functions import kernels as K


def test_batches_of_kernels_are_bounded(spark):
    sizes = K.column(lambda t: t, "string")  # only to set the bound
    texts = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    texts.select(sizes("t")).count()
    seen = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert len(seen) > 1 and max(r.n for r in seen) <= 2 * K.BATCH_BYTES >> 20
