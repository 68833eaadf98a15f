"""Feed files loaded as they land: the scheduled run as a stream.

Each micro-batch is one load. A batch that is repeated after a failure adds
only what is not stored yet, so nothing is loaded twice. Responses that are not
valid JSON are filed under the number of their micro-batch; a repeated batch
writes its own again.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.pipeline import run
from touchline.sources.feed import CORRUPT, KEPT, unpack_responses, unreadable_of
from touchline.sources.paths import exists
from touchline.sources.store import MatchStore

_UNREADABLE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("micro_batch", T.LongType())])


def unreadable_path(store: MatchStore) -> str:
    return f"{store.path}/unreadable"


def unreadable_landed(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``response`` and ``micro_batch`` of what streams could not read."""
    if not exists(spark, path):
        return spark.createDataFrame([], _UNREADABLE)
    return spark.read.schema(_UNREADABLE).parquet(path)


def ingest_landed(spark: SparkSession, landing: str, store: MatchStore, checkpoint: str,
                  league: str | None = None, season: int | None = None,
                  files_per_batch: int = 1000, unreadable: str | None = None) -> StreamingQuery:
    """Load every file not loaded before, then stop.

    Unreadable responses go to the folder ``unreadable``, by default one of the store's.
    """
    bad_path = unreadable or unreadable_path(store)
    responses = (
        spark.readStream.schema(KEPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(landing)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        # Read once for both: what is good, and what is not.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            bad = unreadable_of(batch)
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{bad_path}/micro_batch={batch_id}")
            run(unpack_responses(batch.filter(F.col(CORRUPT).isNull())), store, league, season)
        finally:
            batch.unpersist()

    return (
        responses.select("matches", CORRUPT, "_metadata")
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
