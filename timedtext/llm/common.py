"""Shared folder, session settings and small column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Keys that hot_keys() tells at most, the rows from which a key counts as hot, and the parts that its rows are dealt to at most.
HOT_KEYS, HOT_ROWS, HOT_PARTS = 200, 256, 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound Arrow batches (documents can be long)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that the driver and all executors share: spark.checkpoint.dir, or what setCheckpointDir named.

    Without either, a local session takes its warehouse, and any other is an error: its machines share no other folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors. Options are those of the writer."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hot_keys(counts: DataFrame, key: str) -> dict:
    """The most frequent keys of counts (key, n), and into how many parts the rows of each are to be dealt."""
    most = counts.filter(F.col(key).isNotNull()).select(key, "n").orderBy(F.desc("n")).limit(HOT_KEYS).collect()
    return {r[key]: min(HOT_PARTS, -(-r["n"] // HOT_ROWS)) for r in most if r["n"] >= HOT_ROWS}


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def keyed(rows: DataFrame, table: DataFrame, key: str, hot: dict | None = None, how: str = "left") -> DataFrame:
    """rows joined with table on key, where table has at most one row per key; no key's rows all go to one task.

    hot is what hot_keys() says of the rows, and is worked out if not given. A hot key's rows are dealt to several parts
    by a salt, and its table row is there once for each; every other key holds less than a HOT_KEYS-th of the rows.
    Rows with a null key match nothing and are dealt out too. how is left or inner.
    """
    hot = hot_keys(counted(rows, key), key) if hot is None else hot
    name = lambda c: f"`{c}`"
    added = [c for c in table.columns if c != key]
    parts = F.create_map(*(F.lit(x) for kv in hot.items() for x in kv)) if hot else None
    told = [name(f.name) for f in rows.schema if isinstance(f.dataType, AtomicType)]  # others are not needed, or have no hash
    of = F.pmod(F.xxhash64(*told), F.coalesce(parts[F.col(key)], F.lit(1))) if hot else F.lit(0)
    nowhere = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))
    left = rows.withColumn("__salt", F.when(F.col(key).isNull(), nowhere).otherwise(of).cast("int"))
    table = table.filter(F.col(key).isNotNull())
    copies = F.sequence(F.lit(0), F.coalesce(parts[F.col(key)], F.lit(1)) - 1) if hot else F.array(F.lit(0))
    return left.join(table.withColumn("__salt", F.explode(copies)), [key, "__salt"], how).select(*map(name, rows.columns), *added)
