"""Tables that outlive executors, joins with hot keys, and free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"
#: A key is hot if it holds over LEAST rows and over one row in HOT; so there are fewer than HOT hot keys, however many rows there are.
HOT, LEAST = 10_000, 1_000
#: Keys of a list that may be broadcast; a longer one is joined by shuffles.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary one is made, but only under a local master: on
    a cluster the executors could not see each other's files, which is an error.
    """
    path = spark.conf.get(FOLDER, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {FOLDER} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set(FOLDER, path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(table: DataFrame) -> None:
    """Remove a table that ``stored`` returned; nothing may read it afterwards."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: str, count: str = "count") -> DataFrame | None:
    """(key, pieces) of the hot keys of (key, count), fewer than HOT; None if there are none."""
    whole = counts.agg(F.sum(count).alias("rows"), F.max(count).alias("most")).first()
    limit = max(LEAST, (whole["rows"] or 0) // HOT)
    if (whole["most"] or 0) <= limit:
        return None
    return counts.where(F.col(count) > limit).select(key, F.ceil(F.col(count) / limit).cast("int").alias("_pieces"))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``lookup``, which has one row for each key.

    Rows of a hot key are dealt by the hash of column ``by`` into that key's
    pieces, and the key's lookup row goes to each piece.  The list of hot keys is
    bounded (see ``hot_keys``), so it is broadcast.
    """
    if hot is None:
        return rows.join(lookup, key, how)
    few = F.broadcast(hot)
    left = rows.join(few, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(by), "_pieces"), F.lit(0)).cast("int")).drop("_pieces")
    right = lookup.join(few, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces")
    return left.join(right, [key, "_piece"], how).drop("_piece")


def keep_rows(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a stored list of keys: broadcast while the list is short, else by shuffles."""
    short = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if short else keys.hint("merge"), key, how)
