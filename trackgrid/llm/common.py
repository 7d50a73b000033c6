"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the words of the contracts consist of, as a Java and a Python pattern.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For bytes.translate: A-Z become lower case, every other ASCII byte that is in no word a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: For bytes.translate: A-Z become lower case.
FOLD_CASE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new temporary one is set only where none is and Spark is local (tests)."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


#: Paths of the tables that stored() has written and dropped() has not removed.
_tables: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: this cuts the lineage.

    The table stays until dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_tables() -> list[str]:
    """The tables that stored() has written so far."""
    return list(_tables)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that stored() has written, once nothing reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _tables.remove(path)


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text: equal texts have equal keys."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def among(df: DataFrame, keys: DataFrame, column: str, bits: int = 1 << 26) -> DataFrame:
    """df with a boolean column `among`: false only if its value of `column` is certainly not in keys.

    keys has this one column. A bitmap of `bits` bits over hashes of the keys, at most bits / 32768 rows of
    4 KB (8 MB), is broadcast whatever the size of keys: true may be wrong, the more often the more keys
    there are, so that a join on the rows that are left is never wrong, only larger. df has no other
    columns of the names bucket, bitmap and among.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = keys.select(place(column).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return df.withColumn("bucket", F.bitmap_bucket_number(place(column))).join(F.broadcast(maps), "bucket", "left").withColumn(
        "among", found
    ).drop("bucket", "bitmap")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes; DuckDB has no such function."""
    steps = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        steps.append(k)
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, CAST({steps}[(xor(c, b) & 255) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT)), 4294967295)"


def sliced(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in a column, one row at least: bounds what a task holds."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n or 0
    if first < len(sizes):
        yield batch.slice(first)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: Edges that one task can take through all rounds.
EDGES = 500_000


def components(edges: DataFrame, few: int = EDGES) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (id, root), root the smallest id of each.

    Alternates the large-star and small-star steps until the edges stay the same. Minima are
    pre-aggregated before each shuffle, and every round ends in a checkpoint. Up to `few` edges stay in one
    task, without the shuffles, whose files would outweigh them. An empty table of edges gives an empty result.
    """
    shared_dir(edges.sparkSession)
    kept = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept, before = kept.checkpoint(), None
    together = (lambda df: df.coalesce(1)) if kept.count() <= few else lambda df: df  # no round has more edges than the last
    while True:
        both = together(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        kept = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = together(kept.unionByName(least.select("a", F.col("m").alias("b")))).distinct().checkpoint()
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return kept.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        kept.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
