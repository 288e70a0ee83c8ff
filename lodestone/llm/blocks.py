"""Small rows that every task needs, in blocks of a bounded size in the shared folder.

The rows are placed into blocks by a hash and written once; the driver learns how
many blocks there are, never what they hold.  A task reads a block's files itself
and keeps the newest block that it made, also for later tasks of its worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ensure_checkpoint_dir

_KEPT: dict[tuple[str, int], object] = {}


def write_blocks(rows: DataFrame, cost: str, block_bytes: int) -> tuple[str, int]:
    """The folder that holds ``rows`` in blocks, and their number.

    ``cost`` is the column with the bytes that a row needs in a task's memory.  The
    number of blocks is the sum of the costs over ``block_bytes``, rounded up; rows
    are placed by a hash of all their columns, so that blocks differ by chance alone.
    """
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    n = max(1, ceil((kept.agg(F.sum(cost)).first()[0] or 0) / block_bytes))
    placed = kept.drop(cost).withColumn("block", F.pmod(F.xxhash64(*[c for c in kept.columns if c != cost]), F.lit(n)).cast("int"))
    placed.repartition(min(n, 200), "block").write.partitionBy("block").parquet(f"{path}/blocks")
    return f"{path}/blocks", n


def read_block(path: str, block: int, make: Callable[[pd.DataFrame], object]) -> object:
    """What ``make`` makes of the rows of a block; made once for a worker until it asks for another block."""
    if (path, block) not in _KEPT:
        import pyarrow.dataset as ds
        from pyarrow import fs

        _KEPT.clear()
        uri = f"{path}/block={block}"
        uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
        system, place = fs.FileSystem.from_uri(uri)
        there = system.get_file_info(place).type != fs.FileType.NotFound
        rows = ds.dataset(place, filesystem=system, format="parquet").to_table().to_pandas() if there else pd.DataFrame()
        _KEPT[path, block] = make(rows)
    return _KEPT[path, block]
