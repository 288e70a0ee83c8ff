"""Watching a tree: edited files enter the index in micro-batches.

Batches run one at a time, and what changes meanwhile waits for the next one.  A
batch that fails is logged and ends the stream, uncommitted: started again with the
same checkpoint, the stream begins with that batch.  Sections of removed files are
archived.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.store import Store
from lodestone.plans.ingest import index_files
from lodestone.session import cut
from lodestone.sources.markdown import EditedMarkdown, read_present

log = logging.getLogger(__name__)


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, available_now: bool = False, interval: str = "500 milliseconds", **options) -> StreamingQuery:
    """Start the stream; stop it with ``query.stop()``.  ``options`` go to ``index_files``."""
    spark.dataSource.register(EditedMarkdown)

    def index(batch: DataFrame, number: int) -> None:
        try:
            now = batch.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).first()[0]
            names = cut(batch.repartition(spark.sparkContext.defaultParallelism))
            index_files(store, read_present(names.where("modified is not null"), root), now, whole_tree=False, paths=names.select("path"), **options)
        except Exception:
            log.exception("batch %s failed", number)
            raise

    stream = spark.readStream.format("edited_markdown").load(root)
    writer = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
