"""Shared plumbing: the shared scratch folder, Arrow batches of whole texts, and safe column names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

#: Texts are handed to Python code in slices of about this many bytes, so that memory is bounded
#: by one slice (or one text, where a single text is longer) and not by Arrow's batch of rows.
SLICE_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="veriloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back.

    Used where a table feeds both a plan made on the driver and the result, so that a lost executor
    repeats a read and not the work, and values that depend on the order of rows stay as written.
    The table is removed by `forget`, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    trim(spark)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._veriloom_path = path
    return out


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM give free native memory back to the system, of which each thread that Spark starts for a broadcast or a shuffle keeps some; whether it could."""
    try:
        jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's class is not open to reflection; its interface is.
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001: a JVM without this command keeps its memory
        return False
    return True


def forget(df: DataFrame) -> None:
    """Remove a table that `materialize` wrote and that no plan still to be run reads."""
    if path := getattr(df, "_veriloom_path", None):
        files, at = _file_system(df.sparkSession, path)
        files.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    """The file system and place of the folder that was made for one table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Bytes of an Arrow batch between the JVM and Python, at most; texts are long, and buffers are doubled as they grow.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now.rstrip("bkmgBKMG")) * units.get(now[-1].lower(), 1)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of an Arrow batch with their texts; null texts come as empty ones."""
    texts = batch.column(batch.schema.get_field_index(column))
    offset, size = 0, 0
    lengths = pc.binary_length(texts).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= SLICE_BYTES or i == len(lengths) - 1:
            part = batch.slice(offset, i + 1 - offset)
            yield part, [x or "" for x in part.column(batch.schema.get_field_index(column)).to_pylist()]
            offset, size = i + 1, 0


def map_texts(df: DataFrame, column: str, function: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str, keep: list[str]) -> DataFrame:
    """Add to the columns of `keep` those that a function of whole texts gives.

    `function` is called once in each Python worker's task and returns the function of texts, so that
    models are loaded once a task.  `schema` describes the kept and the new columns, in this order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _loaded(function)
        try:
            for batch in batches:
                for part, texts in slices(batch, column):
                    held = [part.column(part.schema.get_field_index(k)) for k in keep]
                    yield pa.RecordBatch.from_arrays([*held, *of(texts)], names=names)
        finally:
            del of
            release()

    names = StructType.fromDDL(schema).names
    small_batches(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, schema)


def text_column(function: Callable[[], Callable[[list[str]], pa.Array]], text: Column, kind: str) -> Column:
    """What a function of whole texts gives, as an expression on a text column; `function` is called once in each task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = _loaded(function)
        try:
            for column in batches:
                batch = pa.RecordBatch.from_arrays([column], names=["text"])
                yield pa.concat_arrays([pa.array([], pa.from_numpy_dtype(_KINDS[kind])), *(of(texts) for _, texts in slices(batch, "text"))])
        finally:
            del of
            release()

    # Hints tell Spark that the function maps an iterator of Arrow arrays; they must be the types themselves.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Called non-deterministic, or the optimiser would copy it into filters that it infers and run it twice.
    return F.arrow_udf(run, kind).asNondeterministic()(text.cast("string"))


_KINDS = {"double": "float64", "bigint": "int64"}


_slot: dict[str, object] = {}
_asked: set[str] = set()


def keep(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker holds from task to task; one at a time, so that workers that wait hold no more."""
    _asked.add(key)
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def _loaded(function: Callable[[], object]) -> object:
    """What `function` gives, after dropping what an earlier operator kept in this worker and this one does not ask for."""
    _asked.clear()
    of = function()
    if not _asked:
        _slot.clear()
    return of


def release() -> None:
    """Give memory that is free in this process back to the system; workers wait for their next task with what they hold, and a driver beside its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the frame's, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"__vl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

