"""What the operators of this subpackage share: reading tables, tables in the shared folder, Arrow batches.

Long lineages are cut by writing a Parquet table into the folder that ``spark.checkpoint.dir`` names, which all
executors share.  Only where that setting is absent and Spark runs in one process (tests, notebooks) a folder of our own
is made; on a cluster its absence is an error.  What is written goes when it is dropped, at the latest with Spark's process.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Rows in an Arrow batch.  Documents can be long, so batches are short; a batch is also limited in bytes by Spark.
BATCH_ROWS = 1000

#: The folder made for an application in one process.
_OWN: dict[str, str] = {}
#: Folders of written tables, in order.
_LEFT: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on, and the package for executors that do not have it installed."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, else, in one process, one that this process made."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if (app := spark.sparkContext.applicationId) not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="xmlframe-checkpoints-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


class Tables:
    """Written tables of one run of an operator: ``put`` cuts lineage, ``drop`` and ``keep`` give back the space early."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}", 0
        self.paths: set[str] = set()

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:
            _LEFT.append(self.top)
            at, system = _file_system(self.spark, self.top)
            system.deleteOnExit(at)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        if (path := getattr(df, "_written_at", None)) in self.paths:
            self.paths.discard(path)
            remove(self.spark, path)

    def keep(self, *wanted: DataFrame) -> None:
        """Drops all tables but these, which a result still reads."""
        for path in self.paths - {getattr(df, "_written_at", None) for df in wanted}:
            self.paths.discard(path)
            remove(self.spark, path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, system = _file_system(spark, path)
    system.delete(at, True)


@contextlib.contextmanager
def dropping(spark: SparkSession, but: Tables) -> Iterator[None]:
    """Removes, at the end, the tables that were written meanwhile but for those of ``but``; nothing may read them later."""
    before = set(_LEFT)
    try:
        yield
    finally:
        for top in [x for x in _LEFT if x not in before and x != but.top]:
            remove(spark, top)
            _LEFT.remove(top)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id as long and the text as string, null text as empty; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``f`` on each Arrow batch.  A dict of columns is turned into a batch of ``schema``; None gives no rows."""
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield as_batch(out, to)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def as_batch(out: pa.RecordBatch | dict, schema: pa.Schema) -> pa.RecordBatch:
    if isinstance(out, pa.RecordBatch):
        return out
    return pa.RecordBatch.from_arrays([c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


#: Stands for a null id where rows are ordered by id: behind all others.
LAST = (1 << 63) - 1


def held_out(id_col: Column) -> Column:
    """Rows kept for tests: crc32 of the id as text, modulo 5, is 0.  A row without an id is not one."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def learnable(id_col: Column) -> Column:
    """Rows from which labels may be learned: those with an id that are not held out."""
    return id_col.isNotNull() & ~held_out(id_col)


def told_apart(df: DataFrame, id_col: str, text_col: str, tables: Tables, most: int = 4_000_000) -> DataFrame:
    """(doc_id, v, text): rows of one id with different texts get different ``v``; v is 0 for all other rows.

    A null id becomes LAST, null text is empty.  Ids that have several texts are broadcast up to ``most`` of them (8 bytes
    each); beyond that every row gets its text's hash.
    """
    docs = text_of(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    h = F.xxhash64("text")
    several = tables.put(docs.select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select(F.col("doc_id").alias("twin")))
    n = several.count()
    if not n:
        return docs.select("doc_id", F.lit(0).cast("long").alias("v"), "text")
    if n > most:
        return docs.select("doc_id", h.alias("v"), "text")
    marked = docs.join(F.broadcast(several), F.col("doc_id") == F.col("twin"), "left")
    return marked.select("doc_id", F.when(F.col("twin").isNotNull(), h).otherwise(F.lit(0)).alias("v"), "text")


def own_id(col: Column) -> Column:
    """The id as the caller knows it: null again for LAST."""
    return F.when(col != LAST, col)


def share(id_col: Column, seed: int = 7) -> Column:
    """A number from 0 to 1 that depends on the id alone, for samples that come out alike on every run."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
