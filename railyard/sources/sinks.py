"""Writers for the two shuffle-file layouts, re-aimed as Spark table layouts.

* ``write_hashed_layout``: files placed by string hash into
  ``dir_id / sub_dir`` (two lower-case hex digits), as Hive-style partitions.
* ``write_sorted_blocks``: blocks of every map clustered and ordered by
  reduce id, plus a manifest of ``[offset, next_offset)`` per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.operators.projections import place_by_hash
from railyard.operators.windows import offset_index

HASHED_SCHEMA_EXTRA = "h BIGINT, dir_id INT, sub_id INT, sub_dir STRING"


# --------------------------------------------------------------------------- SNK1
def write_hashed_layout(df: DataFrame, key: str, n_dirs: int, n_sub: int, path: str,
                        mode: str = "overwrite", files_per_dir: int = 4) -> None:
    """Write rows under ``path/dir_id=<d>/sub_dir=<xx>/`` where the placement
    comes from ``place_by_hash`` of ``key``.  Rows are shuffled by the two
    placement columns and dealt out by row, so each directory gets
    ``files_per_dir`` files, written by as many tasks, however many rows share
    a key."""
    placed = place_by_hash(df, key, n_dirs, n_sub)
    deal = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_dir))
    (placed.repartition("dir_id", "sub_dir", deal)
     .write.mode(mode).partitionBy("dir_id", "sub_dir").parquet(path))


def read_hashed_layout(spark, path: str, schema: str) -> DataFrame:
    """Read a hashed layout back with its placement columns typed as written
    (no partition type inference: ``sub_dir`` stays text)."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


# --------------------------------------------------------------------------- SNK2
def write_sorted_blocks(df: DataFrame, map_key: str, reduce_order: Sequence[Column | str],
                        size: Column | str, path: str, block: Column | None = None,
                        mode: str = "overwrite") -> DataFrame:
    """Write every map's blocks clustered by map and ordered by reduce
    position (``path/data``), and a manifest ``path/index`` with the
    0-based reduce index and ``[offset, next_offset)`` of each block (the
    n+1 offsets of the original index file, one row per block).  Returns the
    manifest as read back from storage.  Files hold ranges of ``(map, reduce
    position)``, so the blocks of a large map are written by several tasks."""
    indexed = offset_index(df, [map_key], list(reduce_order), size, block=block)
    (indexed.repartitionByRange(map_key, "idx").sortWithinPartitions(map_key, "idx")
     .write.mode(mode).parquet(f"{path}/data"))
    spark = df.sparkSession
    manifest = spark.read.parquet(f"{path}/data").select(
        map_key, "idx", "offset", "next_offset")
    manifest.write.mode(mode).parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")
