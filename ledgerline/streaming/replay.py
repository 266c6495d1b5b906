"""A table played as a stream, piece by piece: each piece is a run of its own that goes on from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ledgerline.functions.tables import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(pieces: Sequence[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream gives out for pieces of one schema, which come one after the other."""
    spark = pieces[0].sparkSession
    own = new_path(spark, "replay")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for piece in pieces:
        piece.write.mode("append").parquet(f"{own}/in")
        out = stream(spark.readStream.schema(pieces[0].schema).parquet(f"{own}/in"))
        sink = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{own}/checkpoint").option("path", f"{own}/out")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{own}/out")
