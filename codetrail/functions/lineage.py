"""Materialisation as a Parquet table in the shared folder.

The frame is written once, as Parquet, to the folder that the session names in ``spark.checkpoint.dir`` and read back:
its lineage is cut, the files survive the loss of executors, and later reads prune columns and push filters down, which
a row-based checkpoint does not.  Joins of such tables go by measured sizes (``join_by_measured_size``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrail.session import ensure_checkpoint_dir, join_by_measured_size


def materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    join_by_measured_size(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    # a column that is only null has no Parquet type
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    out = df.withColumns({c: F.col(c).cast("string") for c in void}) if void else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
