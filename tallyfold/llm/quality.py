"""Quality scores by supervised subword embeddings.

The features of a text are its words, the runs of three to five code points of each word between marks, and its pairs of consecutive words, each hashed to
one of ``BUCKETS`` vectors. A word equal to the one before is the marker of a repetition. The mean of the vectors goes through a linear layer and
softmax; vectors and layer are learned together by stochastic gradient descent in NumPy.

Training texts are a bounded sample of the labelled ones: at most ``EXAMPLES`` of each class, those of the least hash. They lie in
``SHARDS`` parts; in each of ``ROUNDS`` rounds a task for each part goes on from the common model, and the models of the parts are averaged.
Classes weigh alike while training; afterwards the log odds are fitted to all sampled labels by their shares (a scale and an intercept), so that scores are
probabilities.

Scoring needs no vectors: mean and layer are linear, so each bucket has one number, and a text's log odds are the mean of its
features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import MIX, Words, hash_words, mixed, parts, saved, seeded, table

#: Sampled labelled texts of each class at most.
EXAMPLES = 2000
BUCKETS = 1 << 16
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 5
SHARDS = 6
ROUNDS = 5
RATE = 0.5
BATCH = 16
#: A text is the mean of hundreds of vectors; the step of each is scaled up by this.
STEP = 30
#: ``predicted`` is 1 from this score on.
ACCEPT = 0.3
_SAME = hash_words([b"\x00same"])[0]


def word_buckets(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of their parts, and the place of the word that each is of, in rising order."""
    if not distinct:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # All words in one array of code points: a run that holds a line break is of no word.
    text = "<" + ">\n<".join(b"\n".join(distinct).decode("utf-8", "replace").split("\n")) + ">"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = points == 10
    word = np.cumsum(ends)
    hashes, places = [hash_words(distinct)], [np.arange(len(distinct))]
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        rolled = rolled[: len(points) - n + 1] * MIX + points[n - 1 :] + np.uint64(1)
        if n >= SHORTEST:
            whole = np.flatnonzero((word[: len(rolled)] == word[n - 1 :]) & ~ends[: len(rolled)])
            hashes.append(mixed(rolled[whole]))
            places.append(word[whole])
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)[order], place[order]


def pair_buckets(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of pairs of consecutive words in a row, and the rows."""
    row = words.rows()
    at = np.flatnonzero(row[1:] == row[:-1])
    first, second = hashes[at], hashes[at + 1]
    value = np.where(first == second, _SAME, mixed(first * MIX + second))
    return (value % np.uint64(BUCKETS)).astype(np.int64), row[at]


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, share) of each text; the shares of a text add up to 1. A text without words has none."""
    words = Words(column)
    codes, distinct = words.coded()
    hashes = hash_words(distinct)[codes] if distinct else np.empty(0, np.uint64)
    pair, pair_row = pair_buckets(words, hashes)
    bucket_of, place = word_buckets(distinct)
    edges = np.searchsorted(place, np.arange(len(distinct) + 1))
    ends, out = np.searchsorted(pair_row, np.arange(len(column) + 1)), []
    for i in range(len(column)):
        word, times = np.unique(codes[words.first[i] : words.first[i + 1]], return_counts=True)
        size = edges[word + 1] - edges[word]
        at = np.arange(size.sum()) + np.repeat(edges[word] - (np.cumsum(size) - size), size)
        bucket = np.concatenate([bucket_of[at], pair[ends[i] : ends[i + 1]]])
        count = np.concatenate([np.repeat(times, size), np.ones(ends[i + 1] - ends[i], np.int64)])
        names, same = np.unique(bucket, return_inverse=True)
        total = np.bincount(same, weights=count, minlength=len(names))
        out.append((names, (total / max(total.sum(), 1)).astype(np.float32)))
    return out


class Model:
    """Vectors, and the layer above them: two rows of weights and their intercepts."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias

    @classmethod
    def fresh(cls) -> Model:
        random = seeded("subword embeddings")
        return cls(((random.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS), np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32))

    def learn(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, rate: float, random: np.random.Generator) -> None:
        """One pass of stochastic gradient descent over the examples, in batches."""
        order = random.permutation(len(examples))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            size = [len(examples[i][0]) for i in some]
            bucket = np.concatenate([examples[i][0] for i in some])
            share = np.concatenate([examples[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), size)
            parts_ = self.vectors[bucket] * share[:, None]
            hidden = np.stack([np.bincount(row, weights=parts_[:, d], minlength=len(some)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            logits = hidden @ self.weights.T + self.bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(some)), labels[some]] -= 1
            error *= weight[some][:, None]
            back = error @ self.weights
            step = rate * STEP * share
            for d in range(DIMENSIONS):
                self.vectors[:, d] -= np.bincount(bucket, weights=step * back[row, d], minlength=BUCKETS)
            self.weights -= rate * error.T @ hidden / len(some) * BATCH ** 0.5
            self.bias -= rate * error.mean(axis=0)

    def numbers(self) -> np.ndarray:
        """What each bucket adds to the log odds of class 1."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float64)


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        found = bags(batch.column("text"))
        ends = pa.array(np.cumsum([0, *(len(b) for b, _ in found)]).astype(np.int32))
        bucket, share = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(np.int32), share)]
        yield pa.RecordBatch.from_arrays([*lists, batch.column("label"), batch.column("shard")], ["bucket", "share", "label", "shard"])


def _examples(rows: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    bucket, share = (rows[c].combine_chunks() for c in ("bucket", "share"))
    ends = np.cumsum(pc.list_value_length(bucket).to_numpy(zero_copy_only=False))[:-1]
    flat = (np.split(x.flatten().to_numpy(zero_copy_only=False), ends) for x in (bucket, share))
    return list(zip(*flat, strict=True)), rows["label"].to_numpy().astype(np.int64)


def _learning(shared, balance: np.ndarray, rate: float, turn: int):
    def learn(rows: pa.Table) -> pa.Table:
        """The model of a part after one pass: the vectors that moved, and the layer."""
        vectors, weights, bias = shared.value
        own = Model(vectors.copy(), weights.copy(), bias.copy())
        given, label = _examples(rows)
        own.learn(given, label, balance[label], rate, seeded(f"round {turn} {rows['shard'][0].as_py()}"))
        moved = np.flatnonzero((own.vectors != vectors).any(axis=1))
        return pa.table({"n": [len(label)], "at": [moved.astype("<i4").tobytes()], "vectors": [own.vectors[moved].tobytes()], "weights": [own.weights.tobytes()], "bias": [own.bias.tobytes()]})

    return learn


def trained(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """The number of each bucket, the scale and the intercept of the log odds, learned from labelled ``docs`` (doc_id, text).

    Contrary labels of an id count as 0. Without labels of both classes every score is the smoothed share of class 1.
    """
    spark = docs.sparkSession
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    told = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("hash")).join(one, "doc_id")
    sizes = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share)))
    picked = [told.where(F.col("label") == y).distinct().orderBy("hash", "doc_id").limit(examples) for y in (0, 1)]
    # At most 2 * examples rows, so they can be broadcast; only their texts move.
    picked = F.broadcast(saved(picked[0].unionAll(picked[1]), "picked"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text", "doc_id").alias("hash")).join(picked, ["doc_id", "hash"])
    chosen = texts.dropDuplicates(["doc_id", "hash"]).select("text", "label", F.pmod("hash", F.lit(SHARDS)).cast("int").alias("shard")).repartition(SHARDS, "shard")
    sample = saved(chosen.mapInArrow(_bagged, "bucket array<int>, share array<float>, label int, shard int"), "examples")
    taken = {y: min(n, examples) for y, n in sizes.items()}
    balance = np.array([sum(taken.values()) / (2 * taken[y]) for y in (0, 1)], np.float32)
    stands_for = np.array([sizes[y] / taken[y] for y in (0, 1)])
    model = Model.fresh()

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model.vectors, model.weights, model.bias))
        learn = _learning(shared, balance, RATE * (1 - turn / rounds), turn)
        grown = sample.groupBy("shard").applyInArrow(learn, "n long, at binary, vectors binary, weights binary, bias binary").toPandas()
        part = (grown["n"] / grown["n"].sum()).to_numpy()
        vectors = model.vectors.copy()
        for p, at, moved in zip(part, grown["at"], grown["vectors"], strict=True):
            place = np.frombuffer(at, "<i4")
            vectors[place] += np.float32(p) * (np.frombuffer(moved, np.float32).reshape(-1, DIMENSIONS) - model.vectors[place])
        weights = sum(p * np.frombuffer(w, np.float32).reshape(2, -1) for p, w in zip(part, grown["weights"], strict=True))
        bias = sum(p * np.frombuffer(b, np.float32) for p, b in zip(part, grown["bias"], strict=True))
        model = Model(vectors, weights.astype(np.float32), bias.astype(np.float32))
        shared.unpersist()

    numbers, offset = model.numbers(), float(model.bias[1] - model.bias[0])
    number_of = spark.sparkContext.broadcast(numbers)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, _ = _examples(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array([float(number_of.value[b] @ s) + offset for b, s in given], pa.float64()), batch.column("label")], ["odds", "label"])

    seen = sample.mapInArrow(odds, "odds double, label int").toPandas()
    scale, shift = fitted(seen["odds"].to_numpy(), seen["label"].to_numpy(), stands_for[seen["label"].to_numpy()])
    return numbers, scale, shift + scale * offset


def fitted(odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and intercept that make the odds fit the labels best (logistic regression, by Newton's method, slightly held back)."""
    x, beta = np.stack([odds, np.ones(len(odds))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 0.1 * (beta - [1, 0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def scored(docs: DataFrame, training: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``docs`` without text, with score (double) and predicted (int); columns of these names are replaced.

    ``training`` (doc_id, text) are the rows that labels may be learned from. NULL, empty and all-space texts have no feature: their score is that
    of the intercept. Repeated rows are scored alike. An empty table stays empty.
    """
    numbers, scale, intercept = trained(training, labels, examples)
    number_of = docs.sparkSession.sparkContext.broadcast(numbers)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = number_of.value
        for batch in parts(batches, "text"):
            n = len(batch)
            words = Words(batch.column("text"))
            codes, distinct = words.coded()
            row = words.rows()
            bucket, place = word_buckets(distinct)
            number = np.bincount(place, weights=numbers[bucket], minlength=len(distinct))
            features = np.bincount(place, minlength=len(distinct))
            hashes = hash_words(distinct)[codes] if distinct else np.empty(0, np.uint64)
            pair, pair_row = pair_buckets(words, hashes)
            total = np.bincount(row, weights=number[codes], minlength=n) + np.bincount(pair_row, weights=numbers[pair], minlength=n)
            count = np.bincount(row, weights=features[codes], minlength=n) + np.bincount(pair_row, minlength=n)
            odds = scale * total / np.maximum(count, 1) + intercept
            result = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            columns = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array(result), pa.array((result >= ACCEPT).astype(np.int32))], names=[*columns, "score", "predicted"])

    rest = docs.drop("score", "predicted")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema if f.name != "text")
    return rest.mapInArrow(score, f"{kinds}score double, predicted int")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; a fifth of the ids is held out of training."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return scored(docs, docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))


QUERIES = {"op13_quality": op13_quality}
ORACLE: dict[str, str] = {}
