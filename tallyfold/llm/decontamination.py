"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

A document may be a thousand times longer than an item, so their Jaccard similarity says nothing and signatures of whole
documents would miss every item. Containment does not depend on the document's length: each of an item's MinHash values is
among the document's shingle hashes with a probability equal to the containment. Items are partitioned by size (powers of two
of their shingles); each partition keeps as many minima as leave at most ``MISS`` of the pairs at the threshold unfound, or all
shingles where the items are too short for that. A document with any minimum of an item is a candidate, and the share of the item's shingles
in it, compared as text, decides. An item of one to four words has one shingle, of its own length; documents are then searched for runs of that
length too.

Everything is DataFrame functions. Documents are read once: the hashes of their shingles meet an index of all shingles of the items, in which the
minima are marked. The index grows with the benchmark alone. It is broadcast in slices of at most
``SLICE`` shingles, one pass over the documents for each, so what is broadcast at once has a bound. Texts are named by their MD5, so copies are one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import saved, table, text_hash
from tallyfold.operators.reconcile import union_all

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
#: Shingles of items that are broadcast at once: some 200 MB in memory.
SLICE = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _over_runs(array: str, build, size: int = SHINGLE) -> Column:
    """``build`` over each run of ``size`` entries of a column; none if there are fewer."""
    last = F.size(array) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: build([F.get(F.col(array), i + k) for k in range(size)]))


def _shingle(run: list[Column]) -> Column:
    return F.struct(F.xxhash64(*run).alias("hash"), F.concat_ws(" ", *run).alias("shingle"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, hash, shingle, length, n_shingles), each shingle of an item once. Rows of one item_id are one item.

    ``length`` is the number of words of the item's shingles: SHINGLE, or all words of a shorter item.
    """
    split = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    found = _over_runs("w", _shingle)
    for n in range(1, SHINGLE):
        found = F.when(F.size("w") == n, _over_runs("w", _shingle, n)).otherwise(found)
    each = split.select("item_id", F.least(F.lit(SHINGLE), F.size("w")).alias("length"), F.explode(found).alias("s"))
    each = each.select("item_id", "length", "s.hash", "s.shingle").distinct()
    return each.join(each.groupBy("item_id").agg(F.count("*").alias("n_shingles")), "item_id")


def minima(shingle_rows: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, hash): the least hashes of each item, as many as its size partition asks for."""
    enough = math.ceil(math.log(MISS) / math.log(1 - containment)) if containment < 1 else 1
    sizes = shingle_rows.groupBy("item_id", "n_shingles").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    partition = F.floor(F.log2("n_shingles"))
    kept = F.least(F.pow(F.lit(2), partition + 1).cast("int") - 1, F.lit(enough))
    return sizes.select("item_id", F.explode(F.slice("hashes", F.lit(1), kept)).alias("hash"))


def _met(texts: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """(text_hash, item_id, shingle, n_shingles, least): the shingles of the index in the texts."""
    seen = texts.select("text_hash", F.explode(_over_runs("w", _shingle, length)).alias("s")).select("text_hash", "s.hash", "s.shingle")
    of_length = index.where(F.col("length") == length).select("hash", F.col("shingle").alias("known"), "item_id", "n_shingles", "least")
    met = seen.join(F.broadcast(of_length), "hash").where(F.col("shingle") == F.col("known"))
    return met.select("text_hash", "item_id", "shingle", "n_shingles", "least")


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, slice_rows: int = SLICE) -> DataFrame:
    """(text_hash, item_id, n_shared long, n_shingles long, containment double) for texts that hold an item.

    NULL and empty texts hold nothing; items without id, text or words are in nothing. Copies of a text and repeated rows give one row. Empty
    tables give none. Other columns of either table do not matter.
    """
    known = saved(item_shingles(items.where("item_id is not null").select("item_id", "text")), "items")
    marked = known.join(minima(known, containment).withColumn("least", F.lit(True)), ["item_id", "hash"], "left")
    index = saved(marked.withColumn("least", F.coalesce("least", F.lit(False))), "index")
    lengths = [(r["length"], -(-r["n"] // slice_rows)) for r in index.groupBy("length").agg(F.count("*").alias("n")).collect()]
    texts = docs.select(text_hash().alias("text_hash"), words(F.col("text")).alias("w"))
    passes = [_met(texts, index.where(F.pmod("hash", F.lit(n)) == i), length) for length, n in lengths for i in range(n)]
    met = union_all(passes or [_met(texts.limit(0), index, SHINGLE)])
    counts = met.distinct().groupBy("text_hash", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"), F.bool_or("least").alias("candidate"))
    found = counts.where("candidate").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return found.where(F.col("containment") >= containment).select("text_hash", "item_id", "n_shared", "n_shingles", "containment")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns, whatever these are called."""
    bad = saved(leaks(docs, items).select("text_hash").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), text_hash().alias("text_hash"))
    return rows.join(bad, "text_hash", "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item; a repeated row of documents gives a repeated row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = saved(leaks(docs, table(spark, sf_dir, "benchmark")), "found")
    return docs.select("doc_id", text_hash().alias("text_hash")).join(found, "text_hash").drop("text_hash")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, k),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id)
WHERE n_shared / n_shingles >= 0.8
"""

QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE = {"op8_decontamination": SQL}
