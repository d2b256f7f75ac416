"""Katz backoff over words and pairs of words: Good-Turing discounts, exactly normalised backoff weights.

A text is its words (A-Z folded) and one end token; the token before the first is the end token. With c the counts over the training texts,

    P(w | h) = d(c(h, w)) c(h, w) / c(h)          if h w was seen,
             = alpha(h) P(w)                      if not,
    P(w)     = d(c(w)) c(w) / N                   if w was seen; all words never seen share what is left,

where d discounts counts up to ``K`` (Good-Turing), and alpha(h) = (1 - sum of P over the seen pairs of h) / (1 - sum of P(w) over the same w), so that
each row of the model sums to one. A history whose seen pairs leave nothing gives up one part in c(h) + 1.

Layout. Texts are written once as blocks of about ``BLOCK`` tokens: a list of the block's distinct words and each token's place in it. A block asks
for the counts of its words in one shuffle (by word) and for the probabilities of its distinct pairs in a second one (by history), and
gets both back in the order it asked in; nothing moves once a token. Each bucket of words or pairs is a row of the model's tables. A history with over
a millionth of all tokens (and ``HOT_LEAST``) is split over several buckets by the words that follow it; its alpha is summed over them
and goes to all blocks, as there are less than a million such histories.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Words, hash_words, mixed, saved, table
from tallyfold.session import scratch_path

K = 5
BLOCK = 2_000_000
HOT_SHARE = 1_000_000
HOT_LEAST = 200_000
#: Tokens a bucket of words or pairs stands for.
BUCKET = 2_000_000
END = hash_words([b"\n"])[0]


def pack(values: np.ndarray) -> bytes:
    """An array, column after column, as compressed planes of bytes, so that small numbers cost little."""
    import zstandard

    flat = np.ascontiguousarray(values.T).reshape(-1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T).tobytes())


def unpack(packed: bytes, kind: str, columns: int = 1) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return flat if columns == 1 else flat.reshape(columns, -1).T


def pack_rising(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, "<u8"), dtype=np.uint64)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """d(r) for r = 0 to K + 1 (the last stands for all above K), from how many items were seen r times.

    Good-Turing by the numbers as they are; where copies of texts bend them so that some d would not lie between 0 and 1, by a line through their
    logarithms; where that does not fall steeply enough either, half a count is taken off.
    """
    n = np.array([seen.get(r, 0) for r in range(K + 2)], np.float64)
    r = np.arange(1, K + 1)
    smooth = n.copy()
    if (n[1:] > 0).all():
        line = np.polyfit(np.log(np.arange(1, K + 2)), np.log(n[1:]), 1)
        smooth[1:] = np.exp(np.polyval(line, np.log(np.arange(1, K + 2))))
    d = np.ones(K + 2)
    for counts in (n, smooth):
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (K + 1) * counts[K + 1] / counts[1]
            d[r] = ((r + 1) * counts[r + 1] / counts[r] / r - cut) / (1 - cut)
        if (d[r] > 0).all() and (d[r] < 1).all():
            return d
    d[r] = 1 - 0.5 / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, K + 1)] * c


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        words = Words(batch.column("text"))
        codes, distinct = words.coded(lower=True)
        codes = codes.astype(np.int64)
        hashes = np.append(hash_words(distinct), END)
        ends = words.first[1:]
        tokens = np.insert(codes, ends, len(distinct))
        size = np.diff(words.first) + 1
        at = np.concatenate([[0], np.cumsum(size)])
        cut = np.unique(np.searchsorted(at, np.arange(0, at[-1] + BLOCK, BLOCK))).clip(0, len(size))
        for a, b in pairwise(np.unique(np.append(cut, len(size))).tolist()):
            used, local, n = np.unique(tokens[at[a] : at[b]], return_inverse=True, return_counts=True)
            order = np.argsort(hashes[used])
            rank = np.empty(len(used), np.int32)
            rank[order] = np.arange(len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([pack_rising(hashes[used][order])]), pa.array([pack(rank[local].astype("<i4"))]), pa.array([size[a:b].astype("<i4").tobytes()])]
                + [pa.array([batch.column("doc_id").slice(a, b - a).to_pylist()], pa.list_(batch.column("doc_id").type)), pa.array([batch.column("held_out").slice(a, b - a).to_pylist()], pa.list_(pa.bool_()))],
                names=["block", "words", "tokens", "sizes", "doc_ids", "held_out"],
            )
            number += 1


class Block:
    """A block's tokens, and its distinct pairs ordered by bucket, history and word."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.words = unpack_rising(row["words"])
        self.tokens = unpack(row["tokens"], "<i4").astype(np.int64)
        self.size = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.doc_ids, self.held_out = row["doc_ids"], np.array(row["held_out"], bool)
        self.training = np.repeat(~self.held_out, self.size)
        first = np.cumsum(self.size) - self.size
        self.before = np.roll(self.tokens, 1)
        self.before[first] = np.searchsorted(self.words, END)

    def word_bucket(self, buckets: int) -> np.ndarray:
        return (mixed(self.words) % np.uint64(buckets)).astype(np.int64)

    def pairs(self, counts: np.ndarray, number: np.ndarray, buckets: int, hot: int) -> None:
        """Sets history, word, n (in training), bucket of the distinct pairs, and the pair of each token."""
        key = self.before * len(self.words) + self.tokens
        distinct, pair = np.unique(key, return_inverse=True)
        self.history, self.word = distinct // len(self.words), distinct % len(self.words)
        self.n = np.bincount(pair[self.training], minlength=len(distinct))
        parts = (counts[self.history] // hot + 1).astype(np.uint64)
        part = mixed(self.words[self.word]) % parts
        self.bucket = (mixed(self.words[self.history] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((number[self.word], number[self.history], self.bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.history, self.word, self.n, self.bucket = self.history[order], self.word[order], self.n[order], self.bucket[order]
        self.pair = place[pair]


def _edges(sorted_: np.ndarray) -> list[int]:
    return [*np.flatnonzero(np.diff(sorted_, prepend=-1)).tolist(), len(sorted_)]


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, block, words, n)"""
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                n = np.bincount(block.tokens[block.training], minlength=len(block.words))
                bucket = block.word_bucket(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = _edges(bucket[order])
                out = [(int(bucket[order[a]]), block.number, pack_rising(block.words[order[a:b]]), pack(n[order[a:b]].astype("<i8"))) for a, b in pairwise(edges)]
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "block", "words", "n"), map(list, zip(*out, strict=True)), strict=True)), schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("n", pa.binary())]))

    return ask


_ANSWER = "block long, bucket long, words binary, values binary, spectrum array<long>, hot array<struct<word: long, stats: array<double>>>"
_ANSWER_ARROW = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("values", pa.binary()), ("spectrum", pa.list_(pa.int64()))]
    + [("hot", pa.list_(pa.struct([("word", pa.int64()), ("stats", pa.list_(pa.float64()))])))]
)


def _spectrum(c: np.ndarray) -> list[int]:
    """How many items there are, their sum, and how many were seen 1, ..., K + 1 times."""
    c = c[c > 0]
    return [len(c), int(c.sum()), *np.bincount(c[c <= K + 1], minlength=K + 2)[1:].tolist()]


def _count_words(buckets: int):
    def count(rows: pa.Table) -> pa.Table:
        """Of a bucket of words: its row of the word table (block NULL), and each word's count and number for each block that asked.

        Numbers rise as counts fall, so those of common words are small.
        """
        bucket = rows.column("bucket")[0].as_py()
        asked = [unpack_rising(x) for x in rows.column("words").to_pylist()]
        given = [unpack(x, "<i8") for x in rows.column("n").to_pylist()]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate(given), minlength=len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-c, kind="stable")] = np.arange(len(words)) * buckets + bucket
        both = np.stack([c, number], axis=1)
        out = [{"block": None, "bucket": bucket, "words": pack_rising(words[c > 0]), "values": pack(both[c > 0]), "spectrum": _spectrum(c), "hot": None}]
        at = np.cumsum([0, *map(len, asked)])
        for block, a, b in zip(rows.column("block").to_pylist(), at, at[1:], strict=False):
            out.append({"block": block, "bucket": bucket, "words": None, "values": pack(both[place[a:b]]), "spectrum": None, "hot": None})
        return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)

    return count


def _counts(block: Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The training counts and the numbers of a block's words, from the answers of all buckets."""
    order = np.argsort(block.word_bucket(buckets), kind="stable")
    got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("values").to_pylist(), strict=True))
    both = np.empty((len(block.words), 2), np.int64)
    both[order] = np.concatenate([unpack(x, "<i8", 2) for _, x in got])
    return both[:, 0], both[:, 1]


_PAIRS = [("bucket", pa.int64()), ("block", pa.int64()), ("histories", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("n", pa.binary())]


def _ask_pairs(word_buckets: int, buckets: int, hot: int):
    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """(bucket, block, histories with counts, pairs a history, words with counts, n)"""
        out = []
        for row in blocks.to_pylist():
            block = Block(row)
            counts, number = _counts(block, answers, word_buckets)
            block.pairs(counts, number, buckets, hot)
            for a, b in pairwise(_edges(block.bucket)):
                history, word = block.history[a:b], block.word[a:b]
                head = np.flatnonzero(np.diff(history, prepend=-1))
                runs = np.diff(np.append(head, b - a)).astype("<i4")
                histories = np.stack([number[history[head]], counts[history[head]]], axis=1)
                words = np.stack([number[word], counts[word]], axis=1)
                out.append((int(block.bucket[a]), block.number, pack(histories), pack(runs), pack(words), pack(block.n[a:b].astype("<i4"))))
        return pa.Table.from_pydict({name: [x[i] for x in out] for i, (name, _) in enumerate(_PAIRS)}, schema=pa.schema(_PAIRS))

    return ask


def _heavy(c_history: np.ndarray) -> np.ndarray:
    """Histories that may leave nothing: all their pairs may have been seen over K times."""
    return c_history > K


#: What alpha of a history is made of: its pairs seen 1 to K times, the sum of the other counts, and the P(w) of all its seen pairs.
STATS = K + 2


def _answer_pairs(model: dict, hot: int):
    def answer(rows: pa.Table) -> pa.Table:
        """Of a bucket of pairs: its row of the pair table (block NULL), and for each block that asked the counts of its pairs.

        A history with a pair never seen also gets what its alpha is made of.
        """
        bucket = rows.column("bucket")[0].as_py()
        read = lambda name, kind, columns=1: [unpack(x, kind, columns) for x in rows.column(name).to_pylist()]
        runs, asked = read("runs", "<i4"), read("words", "<i8", 2)
        each = read("histories", "<i8", 2)
        histories, first, h = np.unique(np.concatenate(each)[:, 0], return_index=True, return_inverse=True)
        c_history = np.concatenate(each)[first, 1]
        h = np.repeat(h, np.concatenate(runs))
        words, first, w = np.unique(np.concatenate(asked)[:, 0], return_index=True, return_inverse=True)
        c_word = np.concatenate(asked)[first, 1]
        key, place = np.unique(h * np.int64(len(words)) + w, return_inverse=True)
        c = np.bincount(place, weights=np.concatenate(read("n", "<i4")), minlength=len(key)).astype(np.int64)
        owner, seen = key // len(words), c > 0
        stats = np.zeros((len(histories), STATS))
        np.add.at(stats, (owner[seen], np.minimum(c[seen], K + 1) - 1), np.where(c[seen] > K, c[seen], 1))
        stats[:, K + 1] = np.bincount(owner[seen], weights=lower_probability(c_word[key % len(words)][seen], model["d1"], model["total"], model["unseen"]), minlength=len(histories))
        heavy = _heavy(c_history)
        hots = [{"word": int(histories[i]), "stats": stats[i].tolist()} for i in np.flatnonzero(c_history >= hot).tolist()]
        kept = np.stack([histories[owner[seen]], words[(key % len(words))[seen]]], axis=1)
        out = [{"block": None, "bucket": bucket, "words": pack(kept), "values": pack(c[seen]), "spectrum": _spectrum(c), "hot": hots}]
        at, of = np.cumsum([0, *map(len, asked)]), np.cumsum([0, *map(len, each)])
        for i, block in enumerate(rows.column("block").to_pylist()):
            counts = c[place[at[i] : at[i + 1]]]
            mine = h[at[i] : at[i + 1]]
            open_ = np.unique(mine[(counts == 0) | (heavy[mine] & (counts > K))])
            out.append({"block": block, "bucket": bucket, "words": pack(stats[open_]), "values": pack(counts), "spectrum": None, "hot": None})
        return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)

    return answer


def lower_probability(c: np.ndarray, d: np.ndarray, total: int, unseen: float) -> np.ndarray:
    """P(w), by the word's count."""
    return np.where(c > 0, discounted(c, d) / max(total, 1), unseen)


def backoff(stats: np.ndarray, c_history: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha, and what the seen pairs' probabilities are scaled by: one, but for histories that leave nothing."""
    mass = (stats[:, :K] * (np.arange(1, K + 1) * d[1 : K + 1])).sum(axis=1) + stats[:, K]
    mass = mass / np.maximum(c_history, 1)
    full = (mass > 1 - 1e-12) & (c_history > 0)
    scale = np.where(full, c_history / (c_history + 1.0), 1.0)
    return np.where(c_history > 0, (1 - mass * scale) / np.maximum(1 - stats[:, K + 1], 1e-12), 1.0), scale


def _score(model: dict, word_buckets: int, buckets: int, hot: int, hot_of, schema: pa.Schema):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        hot_words, hot_stats = hot_of.value
        for row in blocks.to_pylist():
            block = Block(row)
            kind = np.array(answers.column("order").to_pylist())
            of_words, of_pairs = answers.filter(pa.array(kind == 1)), answers.filter(pa.array(kind == 2))
            counts, number = _counts(block, of_words, word_buckets)
            block.pairs(counts, number, buckets, hot)
            got = sorted(zip(*(of_pairs.column(x).to_pylist() for x in ("bucket", "values", "words")), strict=True))
            c = np.concatenate([unpack(x, "<i8") for _, x, _ in got])
            # Histories with an unseen pair, bucket by bucket, by their numbers: the order in which their parts of alpha came.
            open_ = np.flatnonzero((c == 0) | (_heavy(counts)[block.history] & (c > K)))
            order = np.lexsort((number[block.history[open_]], block.bucket[open_]))
            named = np.stack([block.bucket[open_], block.history[open_]], axis=1)[order]
            named = named[np.append(True, (np.diff(named, axis=0) != 0).any(axis=1))] if len(named) else named
            parts = np.concatenate([unpack(x, "<f8", STATS) for _, _, x in got])
            stats = np.zeros((len(block.words), STATS))
            stats[named[:, 1]] = parts
            if len(hot_words):
                at = np.minimum(np.searchsorted(hot_words, number), len(hot_words) - 1)
                is_hot = hot_words[at] == number
                stats[is_hot] = hot_stats[at[is_hot]]
            alpha, scale = backoff(stats, counts, model["d2"])
            scaled = np.ones(len(block.words))
            known = np.zeros(len(block.words), bool)
            known[named[:, 1]] = True
            scaled[known] = scale[known]
            lower = lower_probability(counts[block.word], model["d1"], model["total"], model["unseen"])
            log = np.log10(np.where(c > 0, discounted(c, model["d2"]) / np.maximum(counts[block.history], 1) * scaled[block.history], alpha[block.history] * lower))
            base = np.log10((counts + 0.1) / (model["total"] + 0.1 * (model["distinct"] + 1)))
            first = np.cumsum(block.size) - block.size
            sums = [np.add.reduceat(x.astype(np.float64), first) for x in (counts[block.tokens] > 0, base[block.tokens], log[block.pair])]
            for i, doc_id in enumerate(block.doc_ids):
                out.append((doc_id, bool(block.held_out[i]), int(block.size[i]), int(sums[0][i]), model["total"], float(sums[1][i]), float(sums[2][i])))
        return pa.Table.from_pydict({f.name: pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)}, schema=schema)

    return score


def _added(df: DataFrame) -> list[int]:
    """The spectrum of all buckets."""
    sums = df.where("spectrum is not null").select(*(F.sum(F.col("spectrum")[i]).alias(f"s{i}") for i in range(K + 3))).first()
    return [int(x or 0) for x in sums]


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text, held_out, ...).

    The model is learned from the rows that are not held out. ``score`` is the model's log10 probability of the text, ``base_score`` that of
    independent words with a tenth added to each count. NULL and empty texts are one end token. Repeated rows count and are scored
    once each. If nothing is left to learn from, all words are unknown. An empty table gives none.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(
        _blocks, f"block long, words binary, tokens binary, sizes binary, doc_ids array<{id_type}>, held_out array<boolean>"
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by block, so that blocks are not shuffled when their answers come back.
    name = f"blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(partitions, "block").option("path", scratch_path(spark, "lm_blocks")).saveAsTable(name)
    blocks = spark.table(name)
    many = blocks.count()
    word_buckets = max(partitions, many // 4)
    words = saved(blocks.mapInArrow(_ask_words(word_buckets), "bucket long, block long, words binary, n binary").groupBy("bucket").applyInArrow(_count_words(word_buckets), _ANSWER), "lm_words")
    distinct, total, *spectrum = _added(words)
    d1 = discounts(dict(enumerate(spectrum, 1)))
    # What the discounts leave to words never seen.
    kept = sum(r * n * d1[r] for r, n in enumerate(spectrum[:K], 1)) + total - sum(r * n for r, n in enumerate(spectrum[:K], 1))
    model = {"total": total, "distinct": distinct, "d1": d1, "unseen": 1 - kept / total if total else 1.0}
    hot = max(HOT_LEAST, total // HOT_SHARE)
    buckets = max(2 * partitions, total // BUCKET)
    of_words = words.where("block is not null").select("block", "bucket", "values")
    asked = blocks.groupBy("block").cogroup(of_words.groupBy("block")).applyInArrow(_ask_pairs(word_buckets, buckets, hot), "bucket long, block long, histories binary, runs binary, words binary, n binary")
    pairs = saved(asked.groupBy("bucket").applyInArrow(_answer_pairs(model, hot), _ANSWER), "lm_pairs")
    _, _, *spectrum = _added(pairs)
    model["d2"] = discounts(dict(enumerate(spectrum, 1)))
    split = pairs.where("hot is not null").select(F.explode("hot").alias("x"))
    sums = split.groupBy("x.word").agg(*(F.sum(F.col("x.stats")[i]).alias(f"s{i}") for i in range(STATS))).toPandas().sort_values("word")
    hot_of = spark.sparkContext.broadcast((sums["word"].to_numpy(np.int64), sums[[f"s{i}" for i in range(STATS)]].to_numpy(np.float64)))
    answers = of_words.select("block", "bucket", "values", F.lit(None).cast("binary").alias("words"), F.lit(1).alias("order")).unionByName(
        pairs.where("block is not null").select("block", "bucket", "values", "words", F.lit(2).alias("order"))
    )
    result = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], result).schema)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model, word_buckets, buckets, hot, hot_of, arrow), result)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document; a tenth of the ids is held out of training."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text", (fold == 0).alias("held_out")))


QUERIES = {"op6_language_model": op6_language_model}
ORACLE: dict[str, str] = {}
