"""What the corpus operators share: word rules, the shared folder and tables that cut lineage."""

from __future__ import annotations

import contextlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..tables import discard, fresh_path, shared_dir  # noqa: F401  for the operators
from . import files

#: ASCII white space: space and U+0009 to U+000D. Everything else belongs to words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluates value once and binds it for body, even inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_CLASS + "+")))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stated_bytes(df: DataFrame) -> int:
    """The size that the plan states for its input; only how finely work is dealt may depend on it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Rows that a file of a narrow table has at least, where there are as many.
FILE_ROWS = 10_000


def in_few(df: DataFrame, most: int) -> DataFrame:
    """df, which has at most so many rows, in a partition for each FILE_ROWS of them, where it would have more.

    For narrow tables that are written: materialise() leaves these to Python workers.
    """
    out = df.coalesce(max(1, -(-most // FILE_ROWS)))
    out._lectern_narrow = True
    return out


def _nullable(field: pa.Field) -> pa.Field:
    """field, whose fields may be null: Spark's structs that are null have null fields, declared so or not."""
    kind = field.type
    if pa.types.is_struct(kind):
        kind = pa.struct([_nullable(f) for f in kind])
    elif pa.types.is_list(kind):
        kind = pa.list_(_nullable(kind.value_field))
    return field.with_type(kind).with_nullable(True)


def by_workers(df: DataFrame, name: str, run=None, schema: str | None = None) -> DataFrame:
    """materialise() for narrow tables, written by Python workers: of df, or of what run makes of its Arrow batches, with that schema.

    Without Hadoop's native library a JVM starts a process for the mode of each file and folder that it writes, and until
    that process runs its own program it counts as large as the JVM. Workers write files of hidden names; the driver holds
    a name for each partition that has rows and renames these, so files of other attempts are never read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = store.makeQualified(named(path)).toString()
    files.create_folder(folder)

    def write(batches):
        import pyarrow.parquet as pq

        uri = b = None
        with contextlib.ExitStack() as stack:
            for b in run(batches) if run else batches:
                if b.num_rows:
                    if uri is None:
                        uri, stream = files.create(folder, ".attempt")
                        kinds = pa.schema([_nullable(f) for f in b.schema])
                        out = stack.enter_context(pq.ParquetWriter(stack.enter_context(stream), kinds))
                    out.write_batch(b.cast(kinds))
        del b
        give_back()
        if uri:
            yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

    for i, row in enumerate(df.mapInArrow(write, "uri string").collect()):
        if not store.rename(named(row["uri"]), named(f"{folder}/part-{i:05}.parquet")):
            raise OSError(f"{row['uri']} can't be renamed")
    out = spark.read.schema(df.schema if schema is None else schema).parquet(folder)
    out._lectern_path = path
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; what in_few() returned is written by_workers()."""
    return by_workers(df, name) if "_lectern_narrow" in vars(df) else tables.materialise(df, name)


def give_back() -> None:
    """Gives memory that this Python worker has freed back to the system; it waits for other tasks and would hold it beside the JVM's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


#: A key with more than this share of all rows is hot; there are fewer than 1 / HOT such keys.
HOT = 1e-3


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, name: str) -> DataFrame:
    """rows with the columns of table, inner, where one key may hold most of the rows.

    table has one row for each key, with n, how many of the total rows have it. Keys of more than HOT of the rows, fewer
    than 1 / HOT of them by that bound, are broadcast; what is left is shuffled, and none of its keys is hot. Null keys fall out.
    """
    kept = materialise(table, f"{name}-keys")
    hot = kept.where(F.col("n") > total * HOT).drop("n").withColumn("_hot", F.lit(True)).withColumnRenamed(key, "_key")
    added = [c for c in table.columns if c not in (key, "n")]
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").drop("_key")
    cold = kept.where(F.col("n") <= total * HOT).drop("n").withColumnRenamed(key, "_key")
    rest = marked.where("_hot IS NULL").drop("_hot", *added).join(cold, F.col(key) == F.col("_key")).drop("_key")
    return marked.where("_hot").drop("_hot").select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))


def shares(rows: DataFrame, key: str):
    """Over how many parts each key's rows are to be dealt, so that no part is hot: a function of a key's column, or None if none is.

    Keys of more than HOT of all rows, and of so many that they matter, are fewer than 1 / HOT; the driver holds these. Their
    parts are fewer than 2 / HOT.
    """
    most = max(rows.count() * HOT, 1000)
    hot = {r[0]: math.ceil(r[1] / most) for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}
    if not hot:
        return None
    table = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    return lambda of: F.when(of.isin(*hot), F.element_at(table, of)).otherwise(F.lit(1))
