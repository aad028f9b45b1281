"""Helpers shared by the operators: row keys, the shared folder, bytes of a batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import drop_folder, materialise, shared_folder, stored

__all__ = ["HOT", "KEY", "NULL_ID", "ROW", "SLOTS", "as_bytes", "drop_folder", "facts_of", "materialise", "only_of", "row_key", "shared_folder", "small_batches", "split_join", "stored", "table", "widened", "without"]

#: Internal columns: the document's id with a stand-in for null, and a hash of its text.
KEY = ("_sx_id", "_sx_hash")
#: Stand-in for a null doc_id. It sorts last, so a null id is never preferred to a real one.
NULL_ID = 2**63 - 1


def row_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Columns that name a row by what it holds. Repeated rows share a key and so a result;
    rows with one id and different texts do not."""
    return {
        KEY[0]: F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)),
        KEY[1]: F.xxhash64(F.col(text)),
    }


#: Bits of a bitmap, and the bytes of a row of a hashed table of numbers; at 64 bits a row a bitmap
#: takes at most SLOTS / 64 * ROW = 16 MB when it is broadcast.
SLOTS, ROW = 1 << 24, 64


def _slots(*key: str) -> dict[str, Column]:
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    return {"_sx_word": F.floor(slot / 64).cast("int"), "_sx_bit": F.pmod(slot, F.lit(64)).cast("int")}


def _held(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """rows with _sx_hit: whether its key has the slot of one of wanted's."""
    bitmap = wanted.select(*[c.alias(n) for n, c in _slots(*key).items()])
    bitmap = bitmap.groupBy("_sx_word").agg(F.bit_or(F.expr("shiftleft(1L, _sx_bit)")).alias("_sx_bits"))
    held = rows.withColumns(_slots(*key)).join(F.broadcast(bitmap), "_sx_word", "left")
    hit = F.coalesce(F.expr("shiftright(_sx_bits, _sx_bit) & 1 = 1"), F.lit(False))
    return held.withColumn("_sx_hit", hit).drop("_sx_word", "_sx_bit", "_sx_bits")


def only_of(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """rows whose key has the slot of one of wanted's, by a bitmap of a fixed size: to be held against a
    table that is too large to broadcast, before a shuffle join with it drops those let through by chance."""
    return _held(rows, wanted, *key).where("_sx_hit").drop("_sx_hit")


def without(rows: DataFrame, unwanted: DataFrame, *key: str) -> DataFrame:
    """rows whose key isn't among unwanted's. Rows that a bitmap of a fixed size clears aren't shuffled: where
    few go, the texts stay where they are. rows is read twice."""
    held = _held(rows, unwanted, *key)
    doubtful = held.where("_sx_hit").drop("_sx_hit").join(unwanted, list(key), "left_anti")
    return held.where("not _sx_hit").drop("_sx_hit").select(*rows.columns).unionByName(doubtful.select(*rows.columns))


def facts_of(rows: DataFrame, facts: DataFrame, *key: str) -> DataFrame:
    """rows left-joined with facts, which have each key once. Only rows that a bitmap of a fixed size lets through are
    shuffled: where few have facts, the texts stay where they are. rows is read twice."""
    held = _held(rows, facts, *key)
    met = held.where("_sx_hit").drop("_sx_hit").join(facts, list(key), "left")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name not in key]
    clear = held.where("not _sx_hit").select(*rows.columns, *more)
    return clear.unionByName(met.select(*clear.columns))


#: Rows of one key that a single task joins.
HOT = 1_000


def split_join(rows: DataFrame, facts: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """rows inner-joined with facts, which have each key once. A key of more than `hot` rows is split: its
    facts are repeated, and its rows dealt out among them, so no task gets them all."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_sx_n")).where(F.col("_sx_n") > hot)
    often = stored(counts.select(key, F.ceil(F.col("_sx_n") / hot).cast("int").alias("_sx_parts")), "often")
    if often.isEmpty():
        return rows.join(facts, key)
    parts = F.coalesce("_sx_parts", F.lit(1))
    others = [c for c in rows.columns if c != key]
    dealt = rows.join(often, key, "left").withColumn("_sx_part", F.pmod(F.xxhash64(*others), parts).cast("int")).drop("_sx_parts")
    copies = facts.join(often, key, "left").withColumn("_sx_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_sx_parts")
    return dealt.join(copies, [key, "_sx_part"]).drop("_sx_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts, and bytes of texts, that go to Python at once. Spark's own bound, 10,000 rows, is a hundred megabytes of
#: ordinary documents, held once as Arrow and once as Python's objects in every worker.
BATCH, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches at BATCH rows and BATCH_BYTES bytes, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8, without decoding it."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def widened(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    """The schema with more columns, of names that it doesn't have, in whatever case: to Spark they are the same."""
    clash = {n.lower() for n, _ in more} & {n.lower() for n in schema.names}
    if clash:
        raise ValueError(f"the frame already has columns named {', '.join(sorted(clash))}")
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more]])
