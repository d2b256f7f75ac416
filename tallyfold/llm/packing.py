"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document is cut into whole sequences from its beginning; what remains (under one sequence) is the stock problem. Remainders are counted by
length, rounded up to ``GRID`` tokens. A linear program finds how often to use each pattern (which lengths share a sequence)
so that all are placed with the least sequences: it begins with one pattern a length, and a knapsack over the program's dual prices
offers the pattern that would improve it most, until none does. Pattern counts are rounded down; the few remainders left are placed by
filling one sequence after the other as full as they allow. The program sees only the histogram, whose size is fixed, so its cost does not
grow with the data.

Documents are ranked within their length; a pattern owns ranges of ranks, so each remainder finds its sequence by a join of its
length and rank with the table of ranges. Ranks are counted in two levels, by slices of hashed ids, so that no length lands in one task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import saved, table

LENGTH = 2048
GRID = 16
END = 1
TOKENIZER = "byte_bpe_50k.json"
#: Remainders a slice of ranks holds about.
SLICE = 50_000
CACHED = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit numbers.

    A byte-level vocabulary is read a second time as ranks where they lie beside it, as these are faster; ids are the same. The parts of a text
    between single spaces are encoded apart from one another and remembered, which the splitting rule allows: a space begins a token unless
    other white space touches it. Other texts are encoded whole.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return whole
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary
    known: dict[str, bytes] = {}

    def part(text: str) -> bytes:
        found = known.get(text)
        if found is None:
            found = np.array(fast(text), "<u4").tobytes()
            if len(known) < CACHED:
                known[text] = found
        return found

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return whole(text)
        parts = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return np.array(fast(text), "<u4").tobytes()
        return part(parts[0]) + b"".join([part(" " + p) for p in parts[1:]])

    return encode


def pieces_of(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole sequences of each row's ids from the beginning, and the remainder."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (i, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            columns = [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack: the dearest choice of sizes, repeated at will, within ``room``; its price and how often it takes each size."""
    worth, took = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        n = np.searchsorted(sizes, space, side="right")
        worth[space] = worth[space - 1]
        if n:
            offers = worth[space - sizes[:n]] + prices[:n]
            i = n - 1 - offers[::-1].argmax()  # of equal offers the largest size: small ones fill gaps later
            if offers[i] > worth[space] + 1e-12:
                worth[space], took[space] = offers[i], i
    counts, space = np.zeros(len(sizes)), room
    while space > 0:
        if took[space] < 0:
            space -= 1
        else:
            counts[took[space]] += 1
            space -= sizes[took[space]]
    return worth[room], counts


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, not rounded: the linear program, to within ``gap`` of its optimum or after 20 pivots a size.

    A revised simplex with an explicit inverse; one column a size, so the basis stays square. The prices swing from one pivot to the next,
    so patterns are sought at a mean of them and the best prices so far, which begin as each size's share of a sequence.
    """
    n = len(sizes)
    patterns = np.diag(np.maximum(room // sizes, 1)).astype(np.float64)
    inverse = np.diag(1 / np.diag(patterns))
    use = inverse @ demand
    centre = sizes / room
    bound = float(demand @ centre)
    for _ in range(20 * n):
        if use.sum() - bound <= gap * use.sum():
            break
        prices = inverse.sum(axis=0)
        for lean in (0.9, 0.5, 0.0):
            asked = np.maximum(lean * centre + (1 - lean) * prices, 0)
            value, column = best_pattern(sizes, asked, room)
            # Prices that no pattern exceeds bound the optimum from below.
            if demand @ asked / max(value, 1e-12) > bound:
                bound, centre = float(demand @ asked / value), asked / value
            if column @ prices > 1 + 1e-9:
                break
        else:
            break
        step = inverse @ column
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, use / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        use = use - amount * step
        use[out] = amount
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        patterns[:, out] = column
    return patterns, np.maximum(use, 0)


def planned(histogram: dict[int, int], length: int = LENGTH, grid: int = GRID) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {rounded length: pieces a sequence}) that place a histogram of rounded lengths exactly."""
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    plan: list[tuple[int, dict[int, int]]] = []
    if left:
        sizes = np.array(list(left)) // grid
        patterns, use = fractional(sizes, np.array(list(left.values()), np.float64), length // grid)
        for j in np.argsort(-use, kind="stable").tolist():
            counts = {int(sizes[i]) * grid: int(patterns[i, j]) for i in np.flatnonzero(patterns[:, j])}
            times = min([int(use[j] + 1e-6), *(left[s] // c for s, c in counts.items())]) if counts else 0
            if times:
                plan.append((times, counts))
                for s, c in counts.items():
                    left[s] -= times * c
    while any(left.values()):
        plan.append((1, _filled(left, length)))
        for s, c in plan[-1][1].items():
            left[s] -= c
    return plan


def _filled(left: dict[int, int], length: int) -> dict[int, int]:
    """The largest piece left and the others that fill its sequence best, by sums that can be reached."""
    first = max(s for s, n in left.items() if n)
    room = length - first
    stages, reach = [], 1
    for s in sorted((s for s, n in left.items() if n), reverse=True):
        n = min(left[s] - (s == first), room // s)
        for _ in range(n):
            stages.append((s, reach))
            reach = (reach | reach << s) & ((1 << (room + 1)) - 1)
            if reach >> room:
                break
        if reach >> room:
            break
    total, counts = reach.bit_length() - 1, {first: 1}
    for s, before in reversed(stages):
        if not before >> total & 1:
            counts[s] = counts.get(s, 0) + 1
            total -= s
    return counts


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece of each row of ``docs`` (doc_id, text, ...).

    NULL and empty texts are the end id alone. Repeated rows are packed once each. Equal lengths are ranked by id, start and checksum; rows equal
    in all of these are interchangeable. Sequence ids are whole numbers without order; the last sequences may be short. An
    empty table gives none.
    """
    if length % GRID or length < GRID:
        raise ValueError(f"a sequence holds a multiple of {GRID} ids")
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, length, path), "pieces").withColumn("size", (F.ceil(F.col("length") / GRID) * GRID).cast("int"))
    total = pieces.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE))
    keyed = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = saved(keyed.groupBy("size", "slice").agg(F.count("*").alias("n")), "slices")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(length, 0)
    plan = [(whole, {length: 1})] * (whole > 0) + planned(histogram, length)
    # Ranges of ranks: (size, from, to, pieces a sequence, first sequence).
    begin, ranges = [0, *accumulate(times for times, _ in plan)], []
    taken: dict[int, int] = {}
    for (times, counts_), base in zip(plan, begin, strict=False):
        for size, each in counts_.items():
            low = taken.get(size, 0)
            taken[size] = low + times * each
            ranges.append((size, low, taken[size], each, base))
    known = "size int, low long, high long, each long, base long"
    by_size = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "slice", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1).join(saved(offsets, "offsets"), ["size", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    table_ = F.broadcast(spark.createDataFrame(ranges, known)).withColumnRenamed("size", "of_size")
    placed = ranked.join(table_, (F.col("size") == F.col("of_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", (F.col("base") + F.floor(at / F.col("each"))).cast("long")).withColumn("seat", at % F.col("each"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "seat").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and where each lies."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
