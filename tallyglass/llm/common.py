"""What the training-data operators share: table access, shared storage, names of columns.

Conventions of every operator in this subpackage

* Input columns are picked by name and copied into private columns, so tables may carry
  any further columns, also ones named like an operator's outputs.
* A null id is a value of its own (it comes back as null); a null text is an empty text.
* Tables without rows give results without rows and with the same schema.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()

#: Rows an Arrow batch may hold. Texts can be long, so batches stay small.
ARROW_ROWS = 256


_CLEAR: dict[str, Callable[[], None]] = {}


def remembers(name: str, clear: Callable[[], None]) -> None:
    """Tell how to empty a cache that an operator keeps in Python workers."""
    _CLEAR[name] = clear


def remember_only(name: str) -> None:
    """Empty the caches of all other operators: a worker serves one after another."""
    for other, clear in _CLEAR.items():
        if other != name:
            clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as DataFrame, through Spark's own reader (any file system).

    A table of fewer files than there are cores is dealt out: a file of one row group is one task,
    and what operators do with a text costs far more than moving it once.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def small_batches(spark: SparkSession) -> None:
    """Make Python workers ready: few texts per Arrow batch, and this package on their path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).parents[2]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for f in sorted((root / "tallyglass").rglob("*.py")):
                z.write(f, f.relative_to(root))
        name = f"{shared_dir(spark)}/tallyglass-{uuid.uuid4().hex}.zip"
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(held.getvalue())
        out.close()
        context.addPyFile(name)
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder is used in local mode (tests on
    one machine); anywhere else that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, arrow_rows: int | None = None, arrow_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the reread table.

    Cuts lineage: a lost executor costs at most the stages since the last written table.
    ``arrow_rows``, ``arrow_bytes``: rows and bytes of an Arrow batch while this table is made.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    own = {CLEANUP: "true"}  # what the write has shuffled is of no further use
    if arrow_rows:
        own["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(arrow_rows)
    if arrow_bytes:
        own["spark.sql.execution.arrow.maxBytesPerBatch"] = str(arrow_bytes)
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(conf).delete(p, True)


def sealed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` within one struct, ``_in``: an operator's own columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"))


def opened(df: DataFrame, columns: list[str], **others: Column) -> DataFrame:
    """The named columns out of ``_in``, some of them replaced, then the other ones."""
    own = [others[c].alias(c) if c in others else F.col("_in").getField(c).alias(c) for c in columns]
    return df.select(*own, *[v.alias(k) for k, v in others.items() if k not in columns])


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it until no column has it."""
    while name in taken:
        name += "_"
    return name


def keyed(doc_id: Column, text: Column) -> Column:
    """The id as a number, or for a null id a number of the text, far above any id in use."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62)))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names: picked(df, _id="doc_id")."""
    return df.select(*[F.col(f"`{src}`").alias(out) for out, src in columns.items()])
