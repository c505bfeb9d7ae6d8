"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it a new one."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark) -> str:
    """Where this application keeps what its operators store."""
    return f"{shared_folder(spark)}/codeloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there: later uses don't compute it again,
    and a lost executor loses none of it. ``clear_scratch`` removes what an application has stored.

    The shuffles that led to it are of no more use. Executors keep their files until the driver has collected what
    refers to them, so it is told to: else the disk holds the shuffles of all stored tables together.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark) -> None:
    """Remove all that this application has stored; results that have not been written yet are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/codeloom-" in file:
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver: what tasks make their batches by."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to the named columns of every Arrow batch, as Python lists; no other column is read."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(dict(zip(columns, (c.to_pylist() for c in batch.columns), strict=True)))
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=arrow)

    arrow = arrow_schema(schema)
    return df.select(*columns).mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words of a text as an array, natively; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends: what lines are compared by. Single spaces, which are
    nearly all, are no match."""
    return F.trim(F.regexp_replace(F.lower(line), r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*", " "))


def words_in(line: Column) -> Column:
    """Words of a normal line, by its spaces."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without its lines at ``places`` (distinct, from 0). What stands between two places is taken in one
    piece, so the work grows with the number of lines."""

    def rest(x: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), x["places"], F.array(F.size(x["lines"])))
        return bind(ends, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.slice(x["lines"], F.get(e, i - 1) + 2, F.get(e, i) - F.get(e, i - 1) - 1))), "\n"))

    return bind(F.struct(F.split(text, "\n").alias("lines"), F.array_sort(places).alias("places")), rest)
