"""What the training-data operators share: shared-folder storage, lineage cuts,
bounded Arrow batches and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python.  Texts may be very long, so batches
#: stay far below Spark's default of 10,000 rows.
ARROW_ROWS = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local master,
    as in tests, gets a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cadastra-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    base = _SCRATCH[-1] if _SCRATCH else checkpoint_dir(spark).rstrip("/")
    return f"{base}/cadastra-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables written inside are deleted at the end; what is needed later must be
    checkpointed or written by then."""
    path = shared_path(spark, name)
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.pop()
        drop_path(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of intermediate rows from the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``ARROW_ROWS`` rows: the rows are cut again
    in the worker, and the session's own setting is lowered where it is Spark's default,
    so that batches of long texts stay small on their way too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(i, ARROW_ROWS) for b in batches for i in range(0, b.num_rows, ARROW_ROWS))

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of one key that a task takes at least, and how many keys may be dealt apart.
KEY_ROWS, HOT_KEYS = 2000, 100_000


def join_unique(many: DataFrame, few: DataFrame, on: list[str], sizes: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined to ``few``, whose keys ``on`` are unique; ``sizes(*on, rows)`` tells
    how many rows of ``many`` a key has and should be a stored table.

    Keys of many rows are dealt over several tasks by the hash of ``spread`` and their row
    of ``few`` is repeated.  A key is dealt apart if it has more than ``KEY_ROWS`` rows and
    more than 1 in ``HOT_KEYS`` of all, so at most ``HOT_KEYS`` hashes are broadcast."""
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long")).first()[0]
    limit = max(KEY_ROWS, total // HOT_KEYS)
    hot = sizes.where(F.col("rows") > limit).groupBy(F.xxhash64(*on).alias("_h")).agg(F.max(F.ceil(F.col("rows") / limit)).cast("int").alias("_k"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*on)).join(F.broadcast(hot), "_h", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))

    left = dealt(many).withColumn("_part", F.pmod(F.xxhash64(*spread), F.col("_k")).cast("int")).drop("_h", "_k")
    right = dealt(few).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_h", "_k")
    return left.join(right, [*on, "_part"], how).drop("_part")


_MEMOS: dict = {}


def only_memo(name, make):
    """The worker's memo of one operator.  Python workers live on from stage to stage, so
    a memo that another operator has left behind goes first, and its memory goes back to
    the system: it would count against the executor beside the next operator's."""
    if name not in _MEMOS:
        if _MEMOS:
            _MEMOS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)
        _MEMOS[name] = make()
    return _MEMOS[name]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


#: A graph of no more edges than this is finished by one task.
TASK_EDGES = 400_000


class Forest:
    """Union-find over any keys; the smaller key is the root."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        above = self.above
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while (up := above.get(x, x)) != root:
            above[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def _spanning(batches):
    """Of a partition's edges those that join what was apart: no connection is lost."""
    forest = Forest()
    for b in batches:
        keep = [forest.join(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def _finished(batches):
    forest, nodes = Forest(), set()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(x, y)
            nodes.update((x, y))
    rows = sorted(nodes)
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` of longs.

    Returns one row ``(node, root)`` per node that has an edge, root being the
    smallest node of its component.  Alternates the large-star and small-star
    steps until nothing changes; each step is a grouped minimum (combined before
    the shuffle) and a join back on the same key, so a hub costs its edges and
    never a group held in one task.  Each round is checkpointed, which cuts the
    lineage and survives lost executors.  Before the first round each partition
    drops edges that join nothing new; once at most ``TASK_EDGES`` edges are left, one
    task finishes them.  No edges gives no rows; self-loops, repeated and null-ended
    edges are ignored."""
    whole = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    step = checkpoint(whole.mapInArrow(_spanning, "a long, b long").distinct())
    mark = _mark(step)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        if mark[0] <= TASK_EDGES:
            return checkpoint(step.coalesce(1).mapInArrow(_finished, "node long, root long"))
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        step = checkpoint(small)
        now = _mark(step)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    return step.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        step.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


def annotate(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``row`` (all columns of ``df`` as one struct) and the columns that ``fn`` makes.

    ``fn`` gets the batch's arrays of ``columns`` and returns arrays that match
    ``schema``.  Texts cross to Python once; as the table's own columns stay inside
    ``row`` no name can clash."""
    at = [df.columns.index(c) for c in columns]
    names = [c.split()[0] for c in schema.split(", ")]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    packed = plain.select(F.struct(*plain.columns).alias("row"))

    def run(batches):
        for b in batches:
            row = b.column(0)
            yield pa.RecordBatch.from_arrays([row, *fn([row.field(i) for i in at])], names=["row", *names])

    return map_batches(packed, run, f"row {packed.schema[0].dataType.simpleString()}, {schema}")


def restore(annotated: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` back from ``row``, under their own names."""
    return annotated.select(*[F.col(f"row.c{i}") for i in range(len(like.columns))]).toDF(*like.columns)
