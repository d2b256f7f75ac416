"""Removal of word sequences that occur more than once, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the least hash among its runs of three words, so equal windows
have equal minimisers wherever they stand. Consecutive windows of one minimiser travel together, as one string of words, to the bucket of
that minimiser. In its bucket a string arrives once from each batch, with the number of times it occurred there; the windows of a bucket
are sorted by a hash and equal hashes are compared word by word, so the counts are exact. The strings that hold repeated windows
come back with a bit per window and are joined to the texts by the strings' digests.

Skew. A common passage would make its runs of words the minimisers of all windows near it, each with other words around. So minimisers
are counted first, over all texts, and the hot ones (more than a 20,000th of all strings, hence at most 20,000 of them) rank behind all
others: a window takes a hot minimiser only if it has no other, and then it consists of common runs only and is a copy, which batches merge.
The number of buckets follows the number of strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfold.llm.common import Words, grams, mixed, parts, saved, table, text_hash
from tallyfold.session import bounded_batches

WINDOW = 35
RUN = 3
#: A string of words holds so many windows at most; longer stretches are cut, each window stays in one string.
LONGEST = 256
HOT_SHARE = 20_000
BUCKET_STRINGS = 40_000
#: Bytes of text whose strings are merged before they are sent.
PACKED = 1 << 22
_HOT = np.uint64(1 << 63)


def _order(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The rank of each run of RUN words; hot ones rank last."""
    rank = grams(hashes, RUN) >> np.uint64(1)
    if len(hot) and len(rank):
        place = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
        rank[hot[place] == rank] |= _HOT
    return rank


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest and len(values) > rest else values if not rest else values[:0]


class Strings:
    """The strings of a batch of texts: first window and number of windows of each, its minimiser, row and words."""

    def __init__(self, column, hot: np.ndarray, window: int):
        self.words = words = Words(column)
        self.window = window
        count = max(0, len(words) - window + 1)
        least = _least(_order(words.hashes(), hot), window - RUN + 1)[:count]
        row = words.rows()
        whole = row[:count] == row[window - 1 :][:count] if count else np.empty(0, bool)
        at = np.flatnonzero(whole)
        same = np.zeros(len(at), bool)
        if len(at):
            same[1:] = (np.diff(at) == 1) & (least[at[1:]] == least[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
        head = np.flatnonzero(~same)
        length = np.diff(np.append(head, len(at)))
        pieces = -(-length // LONGEST)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first = np.repeat(at[head], pieces) + piece * LONGEST
        self.count = np.minimum(np.repeat(length, pieces) - piece * LONGEST, LONGEST)
        self.minimiser = least[self.first]
        self.row = row[self.first]

    def texts(self) -> Iterator[bytes]:
        data = self.words.data.tobytes()
        begin, end = self.words.start[self.first], self.words.end[self.first + self.count + self.window - 2]
        return (data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))


def digest(text: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text)


def _minimisers(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            strings = Strings(batch.column("text"), np.empty(0, np.uint64), window)
            found, n = np.unique(strings.minimiser, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["minimiser", "n"])

    return count


def _packed(hot: np.ndarray, window: int, buckets: int):
    """Each batch's strings, one row (bucket, strings, copies) a bucket: lengths, numbers of copies and bytes, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in parts(batches, "text", PACKED):
            strings = Strings(batch.column("text"), hot, window)
            once: dict[bytes, int] = {}
            copies, kept, texts = [], [], []
            for i, text in enumerate(strings.texts()):
                j = once.setdefault(text, len(copies))
                if j == len(copies):
                    copies.append(1)
                    kept.append(i)
                    texts.append(text)
                else:
                    copies[j] += 1
            del once
            bucket = (mixed(strings.minimiser[kept]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, copies = bucket[order], np.array(copies, np.int64)[order]
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist() if len(bucket) else [0]
            rows: dict[str, list] = {"bucket": [], "lengths": [], "copies": [], "strings": []}
            squeeze = zstandard.ZstdCompressor(level=1)
            for a, b in pairwise(edges):
                part = [texts[i] for i in order[a:b].tolist()]
                rows["bucket"].append(int(bucket[a]))
                rows["lengths"].append(np.fromiter(map(len, part), "<i4", b - a).tobytes())
                rows["copies"].append(copies[a:b].astype("<i4").tobytes())
                rows["strings"].append(squeeze.compress(b"".join(part)))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int64()), ("lengths", pa.binary()), ("copies", pa.binary()), ("strings", pa.binary())]))

    return pack


def _repeated(window: int):
    def count(rows: pa.Table) -> pa.Table:
        """The strings of a bucket that hold windows which occur more than once: (digest, bits)."""
        import zstandard

        expand = zstandard.ZstdDecompressor()
        texts: dict[bytes, int] = {}
        for lengths, copies, packed in zip(*(rows.column(c).to_pylist() for c in ("lengths", "copies", "strings")), strict=True):
            data, at = expand.decompress(packed), 0
            for length, n in zip(np.frombuffer(lengths, "<i4").tolist(), np.frombuffer(copies, "<i4").tolist(), strict=True):
                text = data[at : at + length]
                at += length
                texts[text] = texts.get(text, 0) + n
        strings, weight = list(texts), np.fromiter(texts.values(), np.int64, len(texts))
        del texts
        words = Words(pa.array(strings, pa.binary()))
        codes, _ = words.coded()
        count = max(0, len(words) - window + 1)
        row = words.rows()
        at = np.flatnonzero(row[:count] == row[window - 1 :][:count])
        hashed = np.zeros(count, np.uint64)
        spread = mixed(codes.astype(np.uint64) + np.uint64(1))
        for i in range(window):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + spread[i : i + count]
        hashed, owner = mixed(hashed[at]), row[at]
        order = np.argsort(hashed, kind="stable")
        at, owner, hashed = at[order], owner[order], hashed[order]
        head = np.append(np.flatnonzero(np.diff(hashed) != 0) + 1, len(hashed))
        head = np.insert(head, 0, 0) if len(hashed) else np.zeros(1, np.int64)
        size = np.diff(head)
        total = np.add.reduceat(weight[owner], head[:-1]) if len(hashed) else np.empty(0, np.int64)
        again = np.repeat(total > 1, size)
        lead = np.repeat(at[head[:-1]], size) if len(hashed) else at
        chosen = np.flatnonzero(again)
        for i in range(window):  # word by word against the first of equal hash
            wrong = codes[at[chosen] + i] != codes[lead[chosen] + i]
            if wrong.any():
                again = _exactly(codes, at, weight[owner], window)
                break
        at, owner = at[again], owner[again]
        order = np.argsort(at)
        at, owner = at[order], owner[order]
        spans = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner)).tolist() if len(owner) else [0]
        names, bits = [], []
        for a, b in pairwise(spans):
            mask = np.zeros(LONGEST, bool)
            mask[at[a:b] - words.first[owner[a]]] = True
            names.append(digest(strings[owner[a]]))
            bits.append(np.packbits(mask).tobytes())
        return pa.table({"digest": pa.array(names, pa.binary()), "bits": pa.array(bits, pa.binary())})

    return count


def _exactly(codes: np.ndarray, at: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which windows occur more than once, by sorting the windows themselves: for when hashes collide."""
    _, group = np.unique(codes[at[:, None] + np.arange(window)], axis=0, return_inverse=True)
    return np.bincount(group.ravel(), weights=weight)[group.ravel()] > 1


def _places(hot: np.ndarray, window: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each string stands: (digest, text_hash, first): ``first`` is its first word in the text."""
        for batch in parts(batches, "text"):
            strings = Strings(batch.column("text"), hot, window)
            column = batch.column("text")
            used, inverse = np.unique(strings.row, return_inverse=True)
            names = pa.array([hashlib.md5(x.as_buffer()).digest() for x in map(column.cast(pa.binary()).__getitem__, used.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(digest, strings.texts()), pa.binary()), names.take(pa.array(inverse)), pa.array((strings.first - strings.words.first[strings.row]).astype(np.int32))],
                ["digest", "name", "first"],
            )

    return place


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts without their covered words."""
        for batch in parts(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            firsts, bits = batch.column("firsts").to_pylist(), batch.column("bits").to_pylist()
            words = Words(batch.column("text"))
            total = np.diff(words.first)
            removed, left = np.zeros(len(texts), np.int64), []
            for i, text in enumerate(texts):
                base, n = words.first[i], int(total[i])
                keep = np.ones(n, bool)
                if firsts[i] is not None:
                    cover = np.zeros(n + window + 1, np.int32)
                    for first, mask in zip(firsts[i], bits[i], strict=True):
                        at = first + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))
                        cover[at] += 1
                        cover[at + window] -= 1
                    keep = np.cumsum(cover)[:n] == 0
                removed[i] = n - keep.sum()
                each = (text or b"").split()
                left.append(b" ".join(each if not removed[i] else [w for w, k in zip(each, keep.tolist(), strict=True) if k]))
            out = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(total.astype(np.int64)), pa.array(removed), out, pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())],
                ["row", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct), n_words, n_removed (long), kept (the words left, joined by one space), kept_sha256.

    ``docs`` has ``text`` and any other columns, whatever their names. A NULL or empty text has no words, as has one of
    spaces only: nothing is removed and ``kept`` is empty. A text shorter than a window loses nothing. Rows of equal text are
    occurrences of their own, even with equal id. An empty table stays empty. A text of any length is taken whole; tasks hold some texts of
    ``PACKED`` bytes together, or one longer one.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    bounded_batches(spark)
    counts = saved(texts.mapInArrow(_minimisers(window), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")), "minimisers")
    strings = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(32, strings // HOT_SHARE)).select("minimiser").toPandas()["minimiser"].to_numpy(np.int64)
    hot = np.sort(hot.view(np.uint64))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strings // BUCKET_STRINGS))
    packed = texts.mapInArrow(_packed(hot, window, buckets), "bucket long, lengths binary, copies binary, strings binary")
    repeated = saved(packed.groupBy("bucket").applyInArrow(_repeated(window), "digest binary, bits binary"), "repeated")
    places = texts.mapInArrow(_places(hot, window), "digest binary, name binary, first int").join(repeated, "digest")
    # Copies of a text have the same places: each is kept once.
    spans = places.groupBy("name", "first").agg(F.first("bits").alias("bits")).groupBy("name").agg(F.collect_list("first").alias("firsts"), F.collect_list("bits").alias("bits"))
    spans = saved(spans, "spans")
    rows = docs.select(F.struct("*").alias("row"), "text", F.unhex(text_hash()).alias("name"))
    marked = rows.join(spans, "name", "left").select("row", "text", "firsts", "bits")
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()), StructField("kept_sha256", StringType())]
    schema = StructType([StructField("row", docs.schema), *added])
    return marked.mapInArrow(_cut(window), schema)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op4_substrings": op4_substrings}
ORACLE = {
    "op4_substrings": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h FROM w),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, i + j AS p FROM win JOIN rep USING (h), range(35) t(j)),
cut AS (SELECT r, list(p) AS ps, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (r)
"""
}
