"""What the operators of this subpackage share: scratch tables, row numbers, joins of hot keys, spans."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of scratch tables: what a writing task holds in memory.
ROW_GROUP = 16 << 20
#: Rows of ids that are broadcast at most, about 60 bytes each.
MOST_BROADCAST = 1_000_000
#: A key is hot if more than one row in so many has it, so there are fewer hot keys than this.
HOT_SHARE = 1000

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a session on one machine (tests, a laptop) may lack the setting; it
    gets a temporary folder. On a cluster that would be a folder that the
    executors don't share, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def staged(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the table, not
    the work behind it, and what is read twice is not computed twice. Staged
    tables that nothing needs from then on are given as ``used`` and deleted.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    release(*used)
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables; nothing may read them afterwards."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without names that start with ``_tm_``, which operators use on the way, and the names to give back."""
    free = "_own"
    while any(c.lower().startswith(free) for c in df.columns):
        free += "_"
    names = {f"{free}{i}": c for i, c in enumerate(df.columns) if c.lower().startswith("_tm_")}
    return df.withColumnsRenamed({c: f for f, c in names.items()}), names


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a number that is unique for each row.

    The numbers depend on how the rows are dealt to partitions, so a caller
    stages the result before it uses the number twice.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def small_enough(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The staged table of narrow rows, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(table) if table.count() <= most else table


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of a staged table with one that has each key once, and in ``n`` how many of the rows have it.

    Keys that more than a thousandth of the rows have are fewer than a
    thousand, whatever the data: they are looked up in a list and their rows
    are broadcast, so a hot key stays where its rows are. The others are
    exchanged.
    """
    bound = rows.count() // HOT_SHARE
    hot = [r[0] for r in counted.where(F.col(n) > bound).select(key).collect()]  # fewer than HOT_SHARE
    if not hot:
        return rows.join(counted, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(counted.where(F.col(n) > bound)), key).unionByName(rows.where(~is_hot).join(counted.where(F.col(n) <= bound), key))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the table carries."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def of_arrays(fn: Callable[..., pa.Array], schema: str):
    """A column function of Arrow arrays, a batch at a time; the other columns of the row stay in the JVM."""
    return F.arrow_udf(fn, schema)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows that hold about ``most`` units each."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def byte_lengths(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in ``column`` hold about ``most`` bytes, so that few are Python objects at once."""
    for lo, hi in slices(byte_lengths(batch.column(column)), most):
        yield batch.slice(lo, hi - lo)


def spans_text(spans) -> F.Column:
    """``kind:start:end`` of an ordered array of structs, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
