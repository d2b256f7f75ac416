"""Spelling variants: words that differ by one code point, found through an index of variable-length grams.

The grams of a word, put between marks, are found from the left: at each place the shortest run of ``SHORTEST`` to ``LONGEST`` code points that is
not frequent, a run being frequent if more than one in ``SHARE`` of all runs of its length is like it. Runs that lie within a run before
them are left out. So frequent beginnings are prolonged and rare ones stay short. The dictionary need only hold the frequent runs, which are
``SHARE`` a length at most whatever the number of words, and is broadcast.

For each word, ``affected`` bounds how many of its grams one insertion, deletion or replacement can change or take away, in the worst place. The others are
grams of the changed word too. So of its rarest grams, one more than that bound are enough: two near words have one of them in common, at the
same place or one apart. Only these lists are merged; as keys also hold length and place, they stay short. Every pair that meets is verified by
its edit distance.

``LONGEST`` must leave every word a gram that no single change reaches: a word of n code points needs ``LONGEST <= n / 2 + 1``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import saved, table

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs this many times as often as its variant.
RATIO = 10
#: One run in this many occurrences is misspelt on purpose.
DAMAGED = 31
SHORTEST, LONGEST = 2, 4
SHARE = 1 << 15
#: Code points of text that are searched at a time, and words that are counted before they are handed on.
STRETCH = 1 << 20
HELD = 1 << 17

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BEGIN, _END = "\x02", "\x03"


def runs_of(text: str) -> Counter:
    """The runs of letters of a text, A-Z lower-cased, with their counts."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, at = Counter(), 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text):
            whole = RUN.match(text, end)  # a run is not cut
            end = whole.end() if whole else end
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def damaged(run: str, seed: int) -> str:
    """The run, or in one of ``DAMAGED`` cases the run without a code point; ``seed`` is the crc32 of what comes before it."""
    h = zlib.crc32(run.encode(), seed)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in runs_of(text.as_py() or "").items():
                word = damaged(run, seed)
                if len(word) >= LEAST_LENGTH:
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield done()
    yield done()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) that occur at least ``LEAST_COUNT`` times."""
    counted = docs.select("doc_id", "text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def grams(word: str, frequent: frozenset[str], shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, str]]:
    """(place, gram) of a word that stands between its marks."""
    found, reach = [], 0
    for at in range(len(word) - shortest + 1):
        size = shortest
        while size < longest and at + size < len(word) and word[at : at + size] in frequent:
            size += 1
        if at + size > reach:
            reach = at + size
            found.append((at, word[at:reach]))
    return found


def affected(spans: list[tuple[int, int]], length: int, longest: int = LONGEST) -> int:
    """How many grams (first, end) of a word of ``length``, marks included, one change between the marks can affect at most.

    A change at a place affects the grams that hold it. Behind it, a new gram that begins at or before the changed place may swallow those that
    end within its reach. Grams before it stay: each ends where a run stopped being frequent, and nothing before it reached further.
    """
    most = 0
    for at in range(1, length):
        # The code point at ``at`` is replaced or taken away (not for the mark behind the word), or one is put in before it.
        changed = sum((a <= at < b) or (at < a and b <= at + longest) for a, b in spans) if at < length - 1 else 0
        put_in = sum((a < at < b) or (at <= a and b <= at + longest - 1) for a, b in spans)
        most = max(most, changed, put_in)
    return most


def _indexed(frequent_of, shortest: int, longest: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n, gram, at): the rarest grams of each word, as many as its bound asks for."""
        frequent, counts = frequent_of.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marked = _BEGIN + word + _END
                found = grams(marked, frequent, shortest, longest)
                enough = affected([(a, a + len(g)) for a, g in found], len(marked), longest) + 1
                # Long grams are not counted; what is not frequent is rare, the longer the rarer.
                for at, gram in sorted(found, key=lambda x: (counts.get(x[1], 0), -len(x[1]), x[1], x[0]))[:enough]:
                    for column, value in zip(rows, (word, n, gram, at), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32())], ["word", "n", "gram", "at"])

    return index


def frequent_runs(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE) -> dict[str, int]:
    """The runs of code points that are frequent among the words, and their counts: at most ``share`` of each length."""
    marked = F.concat(F.lit(_BEGIN), "word", F.lit(_END))
    of_size = lambda size: F.transform(F.sequence(F.lit(1), F.length("marked") - size + 1), lambda i: F.substring("marked", i, size))
    sizes = range(shortest, longest + 1)
    each = words.select(marked.alias("marked")).where(F.length("marked") >= longest).select(F.explode(F.flatten(F.array(*map(of_size, sizes)))).alias("gram"))
    counted = saved(each.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    totals = counted.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("total"))
    kept = counted.join(totals, F.length("gram") == F.col("size")).where(F.col("n") * share > F.col("total")).select("gram", "n")
    return {r["gram"]: r["n"] for r in kept.toPandas().to_dict("records")}


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """(a, n_a, b, n_b), both ways: all pairs of distinct words (word, n) at an edit distance of one.

    Words must have 2 * ``longest`` - 2 code points at least.
    """
    counts = frequent_runs(words, shortest, longest, share)
    frequent = frozenset(g for g in counts if len(g) < longest)
    frequent_of = words.sparkSession.sparkContext.broadcast((frequent, counts))
    index = saved(words.select("word", "n").repartition("word").mapInArrow(_indexed(frequent_of, shortest, longest), "word string, n long, gram string, at int"), "gram-index")
    index = index.withColumn("size", F.length("word"))
    left = index.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", "at", "size")
    # A word meets those of its length at the same place, and those one longer at the same place and at the next.
    shift = F.explode(F.array(*[F.struct(F.lit(d).alias("size"), F.lit(p).alias("at")) for d, p in ((0, 0), (1, 0), (1, 1))])).alias("shift")
    right = index.select("word", "n", "gram", "at", "size", shift)
    right = right.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "gram", (F.col("at") - F.col("shift.at")).alias("at"), (F.col("size") - F.col("shift.size")).alias("size"))
    met = left.join(right, ["gram", "size", "at"]).where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()
    pairs = saved(pairs, "near")
    return pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def grouped(words: DataFrame, **index: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n): its near word of largest n, if that n is ``RATIO`` times its own.

    Of near words of equal n the first in code-point order counts. ``root`` follows the forms to the last. As n grows tenfold from form to form, chains are
    short; their lengths are halved in each round.
    """
    near = near_words(words, **index)
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= RATIO * F.col("n").cast("decimal(20,0)")
    rows = saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    roots = saved(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if step.where("next is not null").isEmpty():
            break
        roots = saved(step.select("word", F.coalesce("next", "root").alias("root")), "roots")
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, **index: int) -> DataFrame:
    """``grouped`` for the words of ``docs`` (doc_id, text, anything else).

    NULL and empty texts have no words; a NULL doc_id is read as empty text. Repeated rows count each. An empty table has no words.
    """
    return grouped(saved(word_counts(docs), "words"), **index)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with the form it is a variant of."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_variants": op12_variants}
ORACLE: dict[str, str] = {}
