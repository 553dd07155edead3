"""Small pieces that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a class for regular expressions.
BLANK_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for an application, so that they can import it wherever it lies for the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='quayside-')}/quayside.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, read from the session; where that is unset, as in tests, a temporary one if Spark runs in this process alone, else an error, for executors elsewhere couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        folder = _own_folders.setdefault(name, "") or f"file://{tempfile.mkdtemp(prefix='quayside-')}"
        _own_folders[name] = folder
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that its lineage ends there.

    A lost executor then costs at most a new read. The schema is given, so that
    an empty table reads as well.
    """
    path = f"{_work.get() or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table behind what cut() returned, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, file)


def _delete(session: SparkSession, file: str) -> None:
    path = session._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


#: Where cut() writes in this context (a thread, a task of asyncio): the work folder of what runs there, if it has one.
_work: ContextVar[str | None] = ContextVar("work", default=None)


@contextmanager
def work_folder(session: SparkSession) -> Iterator[str]:
    """What cut() writes within goes to a folder of its own, which is deleted at the end, and nothing else is. So what is to outlive it is written outside, before it ends: see finished()."""
    path = f"{_work.get() or shared_folder(session)}/work-{uuid.uuid4().hex}"
    token = _work.set(path)
    try:
        yield path
    finally:
        _work.reset(token)
        _delete(session, path)


def finished(session: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make() as a table, without what it has written on its way."""
    outside = _work.get()
    with work_folder(session):
        df = make()
        token = _work.set(outside)
        try:
            return cut(df, name)
        finally:
            _work.reset(token)


def step(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """df.select(*keep, made...), with the new columns computed once for each row.

    Filters above a plain select() are moved below it and columns used once are
    written out where they are used, so that a costly array would be made anew
    for each of its elements. inline() of an array of one struct keeps its place.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_others(df: DataFrame, *own: str) -> list[str]:
    """The columns of df but for those that an operator adds under the same names."""
    taken = {name.lower() for name in own}
    return ["`{}`".format(c.replace("`", "``")) for c in df.columns if c.lower() not in taken]


def block_pairs(rows: DataFrame, keys: list[str], most: int | Column, by: str) -> DataFrame:
    """rows with block, i and j, so that any two rows of a key meet under exactly one (key, i, j): in i = j if their block is the same, else in i < j.

    A key with over most rows (a number, or an expression of the keys) is dealt to blocks of about so many by a
    hash of the column by; a row goes once to each block of its key. Keys are not null.
    """
    large = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    met = rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return met.select(*rows.columns, "block", F.inline(each))


def by_group(rows: DataFrame, keys: list[str], f: Callable[[tuple, pd.DataFrame], pd.DataFrame], fields: dict[str, pa.DataType]) -> DataFrame:
    """rows.groupBy(*keys).applyInPandas(f, ...) for very many small groups: they come sorted in whole batches, for a group that Spark sends by itself costs tens of milliseconds. Keys are not null; fields are those of f's results."""
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple = ()
        made: list[pd.DataFrame] = []
        size = 0

        def done() -> None:
            nonlocal size
            out = f(key, pa.Table.from_batches(held).to_pandas())
            if len(out):
                made.append(out)
                size += len(out)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.concat(made, ignore_index=True), schema, preserve_index=False)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= pc.not_equal(batch[k].slice(1), batch[k].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = tuple(batch[k][0].as_py() for k in keys) != key
            starts = [*np.flatnonzero(new).tolist(), n]
            if starts[0] > 0:  # the batch begins with the group that the one before ended with
                held.append(batch.slice(0, starts[0]))
            for at, end in zip(starts, starts[1:], strict=False):
                if held:
                    done()
                held, key = [batch.slice(at, end - at)], tuple(batch[k][at].as_py() for k in keys)
            if size >= 10_000:
                yield full()
                made, size = [], 0
        if held:
            done()
        if made:
            yield full()

    told = ", ".join(f"`{name}` {'string' if pa.types.is_string(kind) else 'long'}" for name, kind in fields.items())
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, told)
