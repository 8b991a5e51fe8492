"""Nearest access kept current while matrix rows arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from qhapaq.operators.access import nearest_access

MATRIX = "cod_ccpp string, cod_ipress string, profile string, duration_s double, distance_m double"


def matrix_stream(spark: SparkSession, path: str, schema: str = MATRIX) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def keep_current(matrix: DataFrame, sink: str, checkpoint: str, name: str = "nearest") -> StreamingQuery:
    """Write the changed origins of each trigger to Parquet under sink; state is one row per (origin, profile).

    A trigger's rows go to a folder of its own number, so a repeated trigger overwrites itself. The latest folder in
    which an origin occurs has its current nearest facility.
    """
    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (nearest_access(matrix).writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint)
            .foreachBatch(put).trigger(availableNow=True).start())


def current(spark: SparkSession, sink: str) -> DataFrame:
    from pyspark.sql import functions as F

    from qhapaq.operators.access import keep_last

    return keep_last(spark.read.parquet(sink), ["cod_ccpp", "profile"], F.col("batch")).drop("batch")
