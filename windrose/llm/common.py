"""What the operators share: table access, Arrow batches, checkpoints."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..sources.scratch import written as as_table

#: Bytes of text that a worker handles at a time, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the workers, once an application, wherever it was imported
    from here; Spark brings the file to every executor."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(sc.applicationId)
    path = f"{tempfile.mkdtemp()}/{package.name}_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """A table that lies in fewer partitions than there are cores, dealt out to them;
    larger ones stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def keep_tables(spark: SparkSession) -> str:
    """The checkpoint folder, which all machines share; set where the context has none."""
    ship(spark)
    return folder(spark)


def _bare_scan(docs: DataFrame) -> bool:
    """Whether docs are rows of the files of one folder, each once at most: a file
    relation under nothing but projections and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().location().rootPaths().size() == 1  # a file that is named twice is read twice


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with the column ``name`` that tells its rows apart and orders equal ones.

    Rows of a bare scan go by file and place in it, whatever order they come in.  After
    anything that may repeat a file's row, as explode and joins do, and without files, the
    table is written first, so that each row has a number of its own, which stays with it
    even if the table's own order changes when it is computed once more."""
    if _bare_scan(docs) and "_metadata" not in docs.columns:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
    return written(docs.select("*", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias(name)))


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: its rows stay as they are even
    if executors are lost, and its lineage is cut."""
    keep_tables(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: as saved(), but compact
    and read by column."""
    ship(df.sparkSession)
    return as_table(df)


def frequent(counts: DataFrame, limit: int, n: str = "n") -> Column:
    """A condition on ``n`` (1 or more) that at most limit rows meet: those above a
    cut, found from a histogram of logarithms that has some thousand rows at most,
    so that no task gathers the tops of all partitions."""
    step = F.floor(F.log2(F.col(n).cast("double")) * 32)
    total, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        total += r.rows
        if total > limit:
            cut = r.step
            break
    return F.lit(True) if cut is None else step > cut


def held_out(id_col: str, folds: int, fold: int = 2):
    """Whether crc32 of the id's decimal text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text; one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    n, total = batch.num_rows, column.nbytes
    if total <= size or n <= 1:
        yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = part = 0
    for i, k in enumerate(lengths):
        if part and part + k > size:
            yield batch.slice(start, i - start)
            start, part = i, 0
        part += k
    yield batch.slice(start, n - start)


def by_slice(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: str = "text", size: int = SLICE_BYTES):
    """A mapInArrow function from a maker of a function on one slice; the maker
    runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, text, size):
                if part.num_rows:
                    yield f(part)

    return run


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
