"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is sent to every executor: its rows and their bytes are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage; one of our own only where none is set and all runs on one machine, as in
    tests. Executors elsewhere couldn't read it, so a cluster without a folder is an error."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="mentionlake-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session has ended, and its folder with it
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage is cut and survives lost executors. The
    table stays until the driver's program ends, since plans built on it are lazy; `discard` removes it earlier."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = path
    weakref.finalize(out, _places.pop, id(out), None)
    return out


_places: dict[int, str] = {}


def discard(df: DataFrame) -> None:
    """Removes a table that `materialise` returned and that no plan still to be run reads."""
    path = _places.get(id(df))
    if path:
        _remove(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` bears, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Texts of an Arrow batch that are worked on together; Spark's own settings bound the batch.
TEXT_BATCH = 1_000


def trim() -> None:
    """Gives freed memory back to the system; idle Python workers would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_udf(spark: SparkSession, kind: str, work: Callable[[pa.Array], pa.Array], done: Callable[[], None] = trim):
    """An Arrow function over one text column, in bounded batches; `done` runs at the end of a task.
    The texts of a batch are worked on ``TEXT_BATCH`` at a time."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            pieces = [work(part.slice(at, TEXT_BATCH)) for at in range(0, len(part), TEXT_BATCH)]
            del part
            yield pa.concat_arrays(pieces) if len(pieces) > 1 else pieces[0] if pieces else work(pa.array([], pa.string()))
        done()

    return F.arrow_udf(run, kind)


def row_key(*names: str) -> F.Column:
    """A digest of some columns of a row, never null: rows of one key are alike in these columns."""
    parts = [F.col(n).cast("string") for n in names]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts]), 256))


def with_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salt: str | None = None, salts: int = 32) -> DataFrame:
    """Join with a table whose rows and bytes are counted first: broadcast up to ``BROADCAST_ROWS`` and
    ``BROADCAST_BYTES``; beyond that a shuffled join whose hot keys are spread over `salts` copies of the small side."""
    some = small.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))).alias("bytes")).first()
    if some.n <= BROADCAST_ROWS and (some.bytes or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), list(keys), how)
    (name,) = fresh(df.join(small, list(keys)), "salt")
    spread = F.pmod(F.xxhash64(F.col(salt)), F.lit(salts)).cast("int") if salt else (F.rand(7) * salts).cast("int")
    copies = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(name, spread).join(copies, [*keys, name], how).drop(name)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph: columns node, component.

    Alternates large-star and small-star steps; each is a partial minimum per node and a join whose
    hot keys (the centre of a huge component) adaptive execution splits. Every round is written to
    the shared folder. It stops when no edge moved; the number of rounds is logarithmic in practice,
    and running out of `rounds` raises instead of returning unfinished labels.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        before, now = now, materialise(small)
        discard(before)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        state = tuple(after)
    raise RuntimeError(f"components did not settle within {rounds} rounds")
