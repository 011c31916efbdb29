"""What the operators of this subpackage share: scratch tables, Arrow helpers, worker caches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs on this machine, a folder of our own; on a
    cluster that would be a folder no executor sees, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("docloom.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("docloom.scratch.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs no more than the task it ran.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts that a worker takes up at once.
SLICE = 512


def rows_in_arrow(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    rows: int | None = None,
    keeps: tuple[str, ...] = (),
) -> DataFrame:
    """``mapInArrow`` of which a worker holds little.

    Batches come in slices of ``rows``, because texts may be long. Of what the
    worker keeps for other work only ``keeps`` stays, and what a task frees goes
    back to the system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from function(batches if rows is None else (b.slice(k, rows) for b in batches for k in range(0, max(1, b.num_rows), rows)))
        give_back()

    return df.mapInArrow(run, schema)


def forget(but: tuple[str, ...] = ()) -> None:
    """Drop the objects of ``worker_cache`` that are not named in ``but``."""
    kept = sys.__dict__.get("_docloom_kept", {})
    gone = [name for name in kept if name not in but]
    for name in gone:
        del kept[name]
    if gone:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(column: pa.Array) -> list[str]:
    """Values of a string column with null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, across its tasks."""
    kept = sys.__dict__.setdefault("_docloom_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def partitions_for(spark: SparkSession, floor: int = 1) -> int:
    """Shuffle partitions the session asks for."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> "F.Column":
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
