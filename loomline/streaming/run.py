"""Running a streaming query to the end of what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from loomline.session import checkpoint_dir


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process all available input, write it to the shared folder and return the written table; restarts resume from its checkpoint."""
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
