"""Helpers shared by the corpus operators: tables, scratch storage, Arrow maps and marked ids."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the Arrow batches that go to Python, and of the pieces in which a batch is worked on.
BATCH_BYTES, PIECE_BYTES = 8 << 20, 2 << 20
#: Bits of a table of marked ids (8 MB), whatever the number of ids.
MARK_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and driver and executors are one process, as
    in local tests, is a folder of this machine chosen; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: what is lost with an executor is read again from the
    shared folder, and jobs that follow don't recompute ``df``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/factloom/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(
    df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch; it must keep no state of a partition.

    The function gets pieces of about ``PIECE_BYTES``, and the memory that a task
    used goes back to the system at its end, so that a worker that is used again
    and again doesn't grow.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in pieces(batch):
                    if (out := per_batch(piece)) is not None and out.num_rows:
                        yield out
        finally:
            release()

    if any("." in c or "`" in c for c in df.columns):  # mapInArrow can't name these; batches go by place
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most ``BATCH_BYTES``; a lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = re.match(r"(\d+)b?$", spark.conf.get(name))
    if not said or not 0 < int(said[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``PIECE_BYTES`` of text."""
    if not batch.num_rows:
        return
    if batch.nbytes <= PIECE_BYTES:
        yield batch
        return
    sizes = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, z in runs_by_bytes(sizes.tolist(), PIECE_BYTES):
        yield batch.slice(a, z - a)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_of(name: str) -> Column:
    """The column of exactly this name, which may have dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


class Marks:
    """Ids that set bits of a table of at most ``MARK_BITS / 64`` rows, which is broadcast.

    A join on ids behind ``keep`` shuffles little more than the rows that it is after.
    Where ids are so many that most bits are set, more rows pass and the join, which
    decides, does the work. Everything stays in the JVM.
    """

    def __init__(self, ids: DataFrame, id_col: str) -> None:
        bits = ids.select(self._bit(column_of(id_col)).alias("b"))
        word, flag = self._word(F.col("b")).alias("word"), self._flag(F.col("b")).alias("flag")
        self.table = materialize(bits.select(word, flag).groupBy("word").agg(F.bit_or("flag").alias("flags")), "marks")

    @staticmethod
    def _bit(ids: Column) -> Column:
        return F.pmod(F.xxhash64(ids.cast("long")), F.lit(MARK_BITS))

    @staticmethod
    def _word(bit: Column) -> Column:
        return F.shiftright(bit, 6).cast("int")

    @staticmethod
    def _flag(bit: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))

    def _join(self, df: DataFrame, ids: Column, how: str) -> DataFrame:
        word, flags = unused("mark_word", df), unused("mark_flags", df)
        bit = self._bit(ids)
        # at most MARK_BITS / 64 rows, whatever the input
        table = F.broadcast(self.table.toDF(word, flags))
        return df.join(table, (self._word(bit) == F.col(word)) & (F.col(flags).bitwiseAND(self._flag(bit)) != 0), how)

    def keep(self, df: DataFrame, ids: Column) -> DataFrame:
        """The rows whose ids are marked (null too), and few others."""
        return self._join(df, ids, "left_semi")

    def leave(self, df: DataFrame, ids: Column) -> DataFrame:
        """The rows that ``keep`` doesn't give."""
        return self._join(df, ids, "left_anti")

    def drop(self) -> None:
        """Delete the table; for when all that was filtered is written."""
        discard(self.table)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: A-Z become a-z; what is no ASCII letter or digit and no byte of a longer character becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 after folding A-Z."""
    return (text or b"").translate(_FOLD).split()


def runs_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes, so that long texts bound no buffer."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by ``[KIND]``; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def span_text(spans: list[tuple[str, int, int]], order: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the kind's place in ``order``, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))
