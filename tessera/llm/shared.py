"""What the operators share: memory of workers, free names, keys in order, sets of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import materialize, scratch_path, shared_dir  # noqa: F401

#: What Python workers keep from one task to the next: by owner, how to drop it.
_memos: dict[str, Callable[[], None]] = {}


def keep_memo(owner: str, drop: Callable[[], None]) -> None:
    _memos[owner] = drop


def begin_task(owner: str) -> None:
    """Called first by a task's Python function: a worker serves many operators, so it drops what others have kept and gives
    memory that is free back to the system."""
    import ctypes

    import pyarrow as pa

    for other in [x for x in _memos if x != owner]:
        _memos.pop(other)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 2_000


def text_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session hold at most TEXT_ROWS rows from here on, as both sides of a worker hold them in memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, TEXT_ROWS)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_order_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a long column more, and its name: in ascending order of the id and different for all rows.

    The id itself where it is a whole number, never null and never repeated; else a number by the order of id (nulls
    first), then text, written to the shared folder so that it stays the same.
    """
    name = free_name(docs, "key")
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ids = docs.select(F.col(id_col).alias("id"))
        if not ids.groupBy("id").count().where("id is null or count > 1").limit(1).count():
            return docs.withColumn(name, F.col(id_col).cast("long")), name
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, text_col)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "keys"), name


#: Bits of a set of keys; 1 MB to broadcast however many keys there are.
KEY_BITS = 1 << 23


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys(key), rows whose key is not): only the first need a join, and a shuffle.

    The set is a bitmap of KEY_BITS hashed keys, made by one aggregation; it is as large for any number of keys, and
    the more there are, the more rows are in the first part.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(KEY_BITS))
    marks = keys.select(place(F.col("key")).alias("p")).groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("m"))
    held = [(r["b"], bytes(r["m"])) for r in marks.collect()]  # at most KEY_BITS / 32768 rows of 4 KB
    if not held:
        return rows.where(F.lit(False)), rows
    b, m, p = (free_name(rows, x) for x in ("bucket", "bitmap", "place"))
    bits = rows.sparkSession.createDataFrame(held, f"{b} long, {m} binary")
    placed = rows.withColumn(p, place(F.col(key)))
    joined = placed.join(F.broadcast(bits), F.shiftright(p, 15) == F.col(b), "left")
    low = F.col(p).bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col(m), (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    here = F.col(m).isNotNull() & (F.get(F.array(*[F.lit(1 << i) for i in range(8)]), low.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(byte) != 0)
    return joined.where(F.coalesce(here, F.lit(False))).select(*rows.columns), joined.where(~F.coalesce(here, F.lit(False))).select(*rows.columns)
