"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is a prime: start and step come from a hash of its
name, so the order visits every slot. The shards take turns; on its turn each claims the first slot of its order that is still
free. All shards end with equally many slots, give or take one, and when a shard leaves, few slots change hands but its own.

The table depends on the shards' names alone. It is filled once on the driver (its size is a parameter), is broadcast as
``slots`` rows, and a row finds its shard by one hash and one lookup: no shuffle, nothing that grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import table

SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: A prime over 100 times the number of shards keeps their shares within one hundredth of each other.
SLOTS = 4099
MAX_SLOTS = 1_000_003


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order. The step is 1 to slots - 1, so with a prime it reaches all."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def filled(shards: Sequence[str], slots: int) -> list[int]:
    """The shard (by place in ``shards``) that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("there must be shards, with different names, and no more than slots")
    if not 2 <= slots <= MAX_SLOTS or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime, at most {MAX_SLOTS}")
    place = [preference(name, slots) for name in shards]
    position, owner, free = [start for start, _ in place], [-1] * slots, slots
    while free:
        for i, (_, step) in enumerate(place):
            while owner[position[i]] >= 0:
                position[i] = (position[i] + step) % slots
            owner[position[i]] = i
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot int, shard string)."""
    owners, names = ",".join(map(str, filled(shards, slots))), "\x01".join(shards)
    owner = F.element_at(F.split(F.lit(names), "\x01"), F.col("owner").cast("int") + 1)
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", owner.alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's size. NULL counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def placed(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``; columns of these names are replaced.

    Rows with one key go to one shard, repeated rows included; a NULL key goes where the empty one goes. An empty
    table stays empty. Choose a key of few repeats (a document's id, not its source): the key decides the balance.
    """
    rest = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rest.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Write ``df`` as Parquet, one folder per shard; each task writes its own files to each folder."""
    placed(df, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return placed(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard, md5(printf('shard-%02d', i)) AS d FROM range({len(SHARDS)}) t(i)),
prefs AS MATERIALIZED (
  SELECT list(('0x' || substr(d, 1, 8))::BIGINT % {SLOTS} ORDER BY shard) AS start,
         list(('0x' || substr(d, 9, 8))::BIGINT % {SLOTS - 1} + 1 ORDER BY shard) AS step FROM shards),
claims AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner
  UNION ALL
  SELECT turn + 1, pick, list_concat(owner[:pick], [(turn % {len(SHARDS)})::BIGINT], owner[pick + 2:])
  FROM (SELECT turn, owner, list_filter(list_transform(range({SLOTS}), lambda j:
          (start[turn % {len(SHARDS)} + 1] + j * step[turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda s: owner[s + 1] < 0)[1] AS pick
        FROM claims, prefs WHERE turn < {SLOTS})),
owners AS MATERIALIZED (SELECT turn, slot FROM claims WHERE turn > 0)
SELECT d.doc_id, d.slot, printf('shard-%02d', (o.turn - 1) % {len(SHARDS)}) AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents) d
JOIN owners o ON o.slot = d.slot
"""

QUERIES = {"op3_sharding": op3_sharding}
ORACLE = {"op3_sharding": SQL}
