"""Helpers that the corpus operators share: shared storage, row keys, Arrow plumbing, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`, for the regex functions of Spark.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset: a temporary folder in local mode (removed at exit), else a folder under the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            path = tempfile.mkdtemp(prefix="sparloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparloom"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, wide: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    Tables of keys and counts go to at most two files for each core of the cluster, which keeps all cores busy and files few;
    `wide` tables, in proportion to the texts, keep their partitions.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df if wide else df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for df; df can't be read any more."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash128(*columns: Column) -> Column:
    """A 128-bit key (struct of two longs) of plain columns and of which of them are null: equal values, equal keys."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns])
    return F.struct(*[F.xxhash64(F.lit(seed), nulls, *columns).alias(name) for seed, name in ((1, "a"), (2, "b"))])


def row_key(df: DataFrame) -> Column:
    """A 128-bit key over all columns of a row; rows that agree in every column, nulls included, share it."""
    return hash128(*[F.to_json(F.struct(df[c])) if "map" in t or "struct" in t or "array" in t else df[c] for c, t in df.dtypes])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each (a longer text stands alone), so that Python holds few texts at once."""
    start, size, lengths = 0, 0, pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def per_text(df: DataFrame, text: str, keep: list[str], schema: str, make: Callable[[], Callable[[list[bytes]], dict[str, list]]]) -> DataFrame:
    """Rows of `keep` columns plus what the function from make() returns for a list of texts as bytes.

    make() runs once for each task, so that models and memos are built there. `schema` is the DDL of the added columns.
    """
    out = df.select(*keep, F.col(text).cast("string").alias(free_name(df, "_text")))
    names = [c.split()[0] for c in schema.split(", ")]
    whole = ", ".join(f"`{c}` {t}" for c, t in out.dtypes[:-1])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                got = work(text_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), *(x if isinstance(x := got[n], pa.Array) else pa.array(x) for n in names)], names=[*keep, *names])

    return out.mapInArrow(run, f"{whole}, {schema}" if whole else schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star in turn, until the edges stay as they are; each round is written to the shared folder.
    Aggregates and joins only, no neighbour list is collected; nodes without an edge are not returned.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        if both:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = e.join(low, "a")
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if both else linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        after = materialize(star(star(now, True), False), "edges")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
