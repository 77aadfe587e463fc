"""What the corpus operators share: durable intermediates, input columns and byte-level word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes to UTF-8 bytes: A-Z lower-cased, ASCII bytes other than letters and digits made spaces.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local master without it gets a temporary one.

    Raises ValueError on a cluster without the setting, where a local folder would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="voxelflow-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to a Parquet table in the shared folder and read it back: lineage ends there, so lost executors cost one stage.

    The table lives until the application ends (or `clean_up`), because results are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/voxelflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def clean_up() -> None:
    """Delete the intermediate tables of this application."""
    for path, spark in list(_written.items()):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the context may already be gone when the interpreter exits
            pass
        _written.pop(path, None)


atexit.register(clean_up)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as doc_id and text, so that scans prune and other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def chunks(items: Iterable, n_bytes: int, size) -> Iterator[list]:
    """Lists of items whose sizes add up to n_bytes at most (a larger item stands alone)."""
    block, total = [], 0
    for x in items:
        s = size(x)
        if block and total + s > n_bytes:
            yield block
            block, total = [], 0
        block.append(x)
        total += s
    if block:
        yield block


def arrow_rows(batches: Iterable) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, with a slice of a batch in Python at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def n_buckets(rows: int, per_bucket: int = 50_000) -> int:
    """Buckets for numbering rows in parallel: a count that grows with the rows, so that no task numbers them all."""
    return max(1, -(-rows // per_bucket))


def bucket_of(*cols: Column, n: int) -> Column:
    """A bucket that depends on the row's values alone; a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with right, unique by keys, whose column n (dropped) is the number of left's rows that have its key; total: left's rows, about.

    Rows of a key with over a thousandth of total stay where they are: there are few such keys (n adds up to left's rows), so
    their single rows are broadcast. All others are shuffled, and no task gets more than a small share for one key.
    """
    large, small = right.where(F.col("n") * 1000 > total).drop("n"), right.where(F.col("n") * 1000 <= total).drop("n")
    rest = left.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(large), keys).unionByName(rest.join(small, keys))


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that none of the columns starts with, for columns of an operator's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
