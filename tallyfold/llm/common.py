"""What several operators share: words as arrays, scratch tables, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import scratch_path

#: Whatever is not one of these six bytes belongs to a word. All six are ASCII, so UTF-8 can be cut at bytes.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))

#: Bytes of text that array code takes at a time.
PART = 1 << 21

#: Bits of a bitmap: 8 MB.
BITS = 1 << 26
#: Hashes that are broadcast at most.
FEW = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, cut so that the texts of ``column`` in a part hold ``most`` bytes or are one text.

    What is computed for each byte then takes bounded memory, however long the texts of a batch are.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(size, dtype=np.int64), 0
        while begin < len(batch):
            before = total[begin] - size[begin]
            end = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_hash(column: str = "text"):
    """Names a text; NULL for NULL."""
    return F.md5(F.col(column))


class Bitmap:
    """A set of values of a column of which only bits are kept: it may hold a value too many, never one too few.

    Its size is ``bits`` whatever the number of values, so it can be broadcast where a set of values cannot.
    """

    def __init__(self, rows: DataFrame, column: str, bits: int = BITS):
        slot = F.pmod(F.xxhash64(column), F.lit(bits))
        found = rows.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word"))
        found = found.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toPandas()
        words = np.zeros(bits // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        self.shared = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose ``column`` may be in the set."""
        shared = self.shared

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(has_bits(shared.value, hashes)))

        named = rows.select("*", F.xxhash64(column).alias("bitmap_hash"))
        return named.mapInArrow(kept, named.schema).drop("bitmap_hash")


def among(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS, few: int = FEW) -> DataFrame:
    """The rows whose ``column`` is one of the ``keys``, and maybe some more: to be joined with them, without shuffling all rows.

    Up to ``few`` hashes of keys are broadcast, 8 MB; beyond that a bitmap of them.
    """
    hashes = saved(keys.select(F.xxhash64(key).alias("key_hash")).distinct(), "key-hashes")
    if hashes.count() > few:
        return Bitmap(keys, key, bits).keep(rows, column)
    return rows.join(F.broadcast(hashes), F.xxhash64(column) == F.col("key_hash"), "left_semi")


def has_bits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the values of these hashes (those of ``xxhash64``) may be in a bitmap."""
    slot = (hashes.view(np.int64) % np.int64(len(words) * 64)).astype(np.uint64)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def spark_hash(values: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` gives for a column of longs: XXH64 of eight bytes with seed 42."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(values), np.uint64(42) + five + np.uint64(8))
    k = values.view(np.uint64) * two
    k = ((k << np.uint64(31)) | (k >> np.uint64(33))) * one
    h ^= k
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a column of texts (NULL: no words), as arrays over all its rows.

    ``start`` and ``end`` are byte positions in ``data``; the words of row i are ``first[i]:first[i + 1]``. ``spaces`` tells for each byte
    whether it stands between words.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, spaces: np.ndarray = _IS_SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        buffers, n = column.buffers(), len(column)
        at = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
        data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
        at = at - at[0]
        space = spaces[data]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        edge = at[(at > 0) & (at < len(data))]
        begins[edge] = ~space[edge]
        ends[edge - 1] = ~space[edge - 1]
        self.data, self._word_bytes = data, ~space
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def coded(self, lower: bool = False) -> tuple[np.ndarray, list[bytes]]:
        """Each word as its place in a list of the distinct words; ``lower`` folds A-Z."""
        codes, words = self.dictionary(lower)
        return codes, words.to_pylist()

    def dictionary(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """``coded`` with the distinct words as an array."""
        data = self.data[self._word_bytes]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pc.dictionary_encode(words)
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        codes, words = self.coded(lower)
        return hash_words(words)[codes] if words else np.empty(0, np.uint64)

    def rows(self) -> np.ndarray:
        """The row that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word; the last n - 1 have none."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * MIX + hashes[i : i + size]
    return mixed(out)


def seeded(label: str) -> np.random.Generator:
    """The same random numbers everywhere and at all times."""
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little")))


def least_linked(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component in a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def components(edges: DataFrame) -> DataFrame:
    """The connected components of undirected edges (a, b): one row (node, root), root the least node.

    Alternates two contractions: all greater neighbours of a node move to its least one, then all lesser ones do.
    Each round leaves at most as many edges as there were; the rounds grow with the logarithm of the longest path.
    The least neighbours are written before they are joined, so that the edges of a hot node can be split. Two
    tables take turns in holding the edges. An edge from a node to itself gives a component of one; NULL is no node.
    """
    spark = edges.sparkSession
    paths = [scratch_path(spark, "components") for _ in range(3)]

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def least(df: DataFrame) -> DataFrame:
        return stored(df.groupBy("a").agg(F.min("b").alias("m")), paths[2])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    given = edges.where("a is not null and b is not null").select("a", "b")
    now = stored(given.distinct(), paths[0])
    alone = now.where("a = b").select("a")
    alone = saved(alone, "alone")
    before, turn = state(now), 1
    while before[0]:
        both = now.where("a <> b").select("a", "b").unionAll(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both.unionAll(both.select("a", F.col("a").alias("b"))))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        low = least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stored(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), paths[turn])
        after = state(now)
        if after == before:
            break
        before, turn = after, 1 - turn
    stars = now.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = stars.unionAll(stars.select("root", "root")).unionAll(alone.select("a", "a"))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))
