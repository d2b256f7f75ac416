"""Collocations: phrases that occur often and whose words seldom occur apart, counted by Rabin-Karp fingerprints.

A text is cut into pieces at punctuation and line ends, a piece into words. Prefix sums of a polynomial over the words' hashes (modulo 2^64)
give the fingerprint of any run of words in one subtraction. A key is the fingerprint of a run, its language and its length. What is
shuffled is a key, its count, the least and greatest of a second hash of the same run, and a pointer to a text that holds it (the least
hash of such texts, so pointers gather in few texts). No word travels.

A run that occurs ``LEAST`` times has parts that do, so runs are counted by length: words first, then the pairs of two frequent words, then the
runs of three and four words of frequent pairs only. Which keys are frequent is told to the tasks by a bitmap of fixed size, whatever
the size of the corpus. Two keys may share a bit; then a run too many is counted, never one too few.

Runs of equal key and unequal second hash collided: their texts are counted by themselves, by joining words instead of keys. The phrases of frequent
keys are then read out of the texts that the pointers name. Everything after that is joins of frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import BITS, MIX, Bitmap, Words, among, has_bits, hash_words, mixed, parts, saved, spark_hash, table

LONGEST = 4
LEAST = 30
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
INSIDE = 80
TOP = 2000
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Bytes of text whose words are held as arrays at a time.
STRETCH = 1 << 20
#: What ends a piece, and what stands between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
_IS_GAP = _IS_BREAK | np.isin(np.arange(256), list(BLANKS))
#: An odd base has an inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Runs:
    """The runs of words within the pieces of a part of the texts, and their keys.

    ``width`` is the number of bits of a fingerprint that are used; fewer than 64 are for tests of collisions.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array, width: int = 64):
        self.words = words = Words(texts, _IS_GAP)
        self.codes, self.distinct = words.coded(lower=True)
        n = len(words)
        row = words.rows()
        ends = np.append(0, np.cumsum(_IS_BREAK[words.data], dtype=np.int64))[words.start] if n else np.empty(0, np.int64)
        self.joined = (row[1:] == row[:-1]) & (ends[1:] == ends[:-1])
        coded = langs.fill_null(NO_LANGUAGE).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[row]
        self.salt = mixed(hash_words([x.encode() for x in self.langs]) + MIX)[self.lang] if n else np.empty(0, np.uint64)
        self.mask = np.uint64((1 << width) - 1)
        hashes = hash_words(self.distinct)
        self.sums = self._prefix(hashes[self.codes] if n else hashes)
        self.second = self._prefix(mixed(hashes ^ MIX)[self.codes] if n else hashes)
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE))) if n else np.ones(1, np.uint64)

    @staticmethod
    def _prefix(hashes: np.ndarray) -> np.ndarray:
        """Sums of the hashes, each times a falling power of the base."""
        falling = np.cumprod(np.append(np.uint64(1), np.full(max(0, len(hashes) - 1), _INVERSE)))[: len(hashes)]
        return np.append(np.uint64(0), np.cumsum(hashes * falling, dtype=np.uint64))

    def at(self, size: int) -> np.ndarray:
        """Where a run of ``size`` words begins."""
        fits = np.ones(max(0, len(self.words) - size + 1), bool)
        for i in range(size - 1):
            fits &= self.joined[i : i + len(fits)]
        return np.flatnonzero(fits)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """The keys of the runs of ``size`` words that begin at ``at``; their two lowest bits hold the size."""
        print_ = mixed((self.sums[at + size] - self.sums[at]) * self.powers[at + size - 1] + self.salt[at]) & self.mask
        return (print_ << np.uint64(2)) | np.uint64(size - 1)

    def checks(self, at: np.ndarray, size: int) -> np.ndarray:
        value = mixed((self.second[at + size] - self.second[at]) * self.powers[at + size - 1])
        return (value >> np.uint64(33)).astype(np.int64)

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join(self.distinct[c] for c in self.codes[at : at + size].tolist())


_COUNTED = "lang string, key long, n long, low long, high long, place long"


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return has_bits(bitmap, spark_hash(keys))


def _counts(size: int, frequent: Broadcast | None, width: int):
    """Counts the runs of ``size`` words, or of three words and more; of frequent parts only, where these are known."""

    def selected(runs: Runs) -> Iterator[tuple[np.ndarray, int]]:
        if size == 1:
            yield np.arange(len(runs.words)), 1
            return
        known = np.zeros(len(runs.words), bool)
        at = runs.at(size - 1)
        known[at] = holds(frequent.value, runs.keys(at, size - 1))
        for n in range(size, size + 1 if size == 2 else LONGEST + 1):
            at = runs.at(n)
            for i in range(n - size + 2):
                at = at[known[at + i]]
            yield at, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", STRETCH):
            runs = Runs(batch.column("text"), batch.column("lang"), width)
            place = batch.column("place").to_numpy(zero_copy_only=False)[runs.words.rows()]
            out = [[np.empty(0, np.int64)] * 5]
            for at, n in selected(runs):
                if not len(at):
                    continue
                key = runs.keys(at, n)
                order = np.argsort(key)
                key, at = key[order], at[order]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                check = runs.checks(at, n)
                out.append([key[head].view(np.int64), np.diff(head, append=len(key)), np.minimum.reduceat(check, head), np.maximum.reduceat(check, head), np.minimum.reduceat(place[at], head)])
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            langs: list[str | None] = [None] * len(columns[0])
            if size == 1:
                total = np.bincount(runs.lang, minlength=len(runs.langs))
                langs += runs.langs
                columns = [np.append(c, total if i == 1 else np.zeros(len(total), np.int64)) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["lang", "key", "n", "low", "high", "place"])

    return count


def _phrases_at(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with the keys that point at them: (key, lang, phrase)."""
        for batch in parts(batches, "text", STRETCH):
            runs = Runs(batch.column("text"), batch.column("lang"), width)
            asked = batch.column("keys")
            row_of, sought = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False)), asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            asked_for = set(zip(row_of.tolist(), sought.tolist(), strict=True))
            rows = runs.words.rows()
            names, langs, texts = [], [], []
            for size in range(1, LONGEST + 1):
                at = runs.at(size)
                key = runs.keys(at, size)
                at = at[np.isin(key, sought)]
                key, own = runs.keys(at, size), rows[at]
                # One for each row and key, of those that the row was asked for.
                pair = np.rec.fromarrays([own, key])
                _, once = np.unique(pair, return_index=True)
                for i in once.tolist():
                    if (int(own[i]), int(key[i])) in asked_for:
                        names.append(key[i])
                        langs.append(runs.langs[runs.lang[at[i]]])
                        texts.append(runs.phrase(int(at[i]), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "lang", "phrase"])

    return read


def _spelled(clashing: Broadcast, width: int):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of keys that may have collided, as text, and how often each occurs: (key, lang, phrase, n)."""
        for batch in parts(batches, "text", STRETCH):
            runs = Runs(batch.column("text"), batch.column("lang"), width)
            found: dict[tuple, int] = {}
            for size in range(1, LONGEST + 1):
                at = runs.at(size)
                key = runs.keys(at, size)
                hit = holds(clashing.value, key)
                for i, k in zip(at[hit].tolist(), key[hit].tolist(), strict=True):
                    one = (k, runs.langs[runs.lang[i]], runs.phrase(i, size))
                    found[one] = found.get(one, 0) + 1
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(columns[0], np.uint64).view(np.int64)), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
                ["key", "lang", "phrase", "n"],
            )

    return spell


def frequent_phrases(docs: DataFrame, least: int = LEAST, width: int = 64, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size int, f long) of all runs of one to four words that occur ``least`` times, and (lang, n long) of all languages.

    ``docs`` has text and lang; other columns do not matter. NULL texts are empty, a NULL language is ``und``. Repeated rows count each.
    """
    texts = docs.select("text", "lang", F.xxhash64("text").alias("place")).where("text is not null")
    frequent, totals, above = [], None, None
    for size in (1, 2, 3):
        counted = texts.mapInArrow(_counts(size, above, width), _COUNTED).groupBy("lang", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("place").alias("place"))
        kept = saved(counted.where(F.col("lang").isNotNull() | (F.col("n") >= least)), f"runs-{size}")
        if size == 1:
            totals = kept.where("lang is not null").select("lang", "n")
        frequent.append(kept.where("lang is null").drop("lang"))
        above = Bitmap(frequent[-1], "key", bits).shared
    found = frequent[0].unionAll(frequent[1]).unionAll(frequent[2])
    single = found.where("low = high")
    pointed = saved(single.groupBy("place").agg(F.collect_list("key").alias("keys")), "pointed")
    near = among(texts, "place", pointed, "place", bits)
    named = near.join(pointed, "place").select("text", "lang", "keys").mapInArrow(_phrases_at(width), "key long, lang string, phrase string").distinct()
    out = named.join(single.select("key", F.col("n").alias("f")), "key").select("lang", "phrase", "f")
    clashes = found.where("low <> high")
    if not clashes.isEmpty():
        spelled = texts.mapInArrow(_spelled(Bitmap(clashes, "key", bits).shared, width), "key long, lang string, phrase string, n long")
        out = out.unionAll(spelled.join(clashes.select("key"), "key", "left_semi").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    return out.withColumn("size", (F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "))) + 1).cast("int")), totals


def _wide(column: str) -> Column:
    """Products of counts may pass 64 bits."""
    return F.col(column).cast("decimal(19,0)")


def _some(first: Column, count: Column) -> Column:
    """``count`` words of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def _inside() -> Column:
    """All runs of two and more words within the phrase."""
    of_size = lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: _some(i, s))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), of_size)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = 64, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), all numbers long: the first ``top`` phrases of each language.

    a is the phrase's count, l and r those of the two parts at its lowest-scoring cut, n all words of the language. Ties of score and count are
    ranked by the phrase, cuts that tie by the shorter first part. Empty tables, texts without words and languages without a
    frequent phrase give no row.
    """
    spark = docs.sparkSession
    phrases, totals = frequent_phrases(docs, least, width, bits)
    phrases = saved(phrases, "phrases")
    several = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("first", _some(F.lit(1), F.col("k"))).withColumn("rest", _some(F.col("k") + 1, F.col("size")))
    counts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    both = cut.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(({SCALE} * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c"))
    longer = several.where("size > 2").withColumn("inside", F.explode(_inside()))
    covered = longer.groupBy("lang", F.col("inside").alias("phrase")).agg(F.max("a").alias("most"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * _wide("most") < INSIDE * _wide("a")))
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # A language may hold most phrases: each of its shares is cut to its own first ones before they meet.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = left.withColumn("share", shares).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {"op11_phrases": op11_phrases}
ORACLE = {
    "op11_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase FROM w, range(1, 5) t(s)),
f AS MATERIALIZED (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE s > 1),
k AS (SELECT lang, s, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:s], ' ') AS y FROM c, range(1, 4) t(k) WHERE k < s),
cut AS (SELECT k.*, fx.f AS l, fy.f AS r, ((2000000::HUGEINT * a) // (fx.f + fy.f))::BIGINT AS score FROM k
  JOIN f fx ON fx.lang = k.lang AND fx.phrase = x JOIN f fy ON fy.lang = k.lang AND fy.phrase = y),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, s), lambda m: list_transform(range(1, s - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' ')))))) AS phrase FROM c WHERE s > 2),
gone AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN gone USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * low.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""
}
