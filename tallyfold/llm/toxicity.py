"""Toxicity by the votes of the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index.

Terms are words and the beginnings of words (so that the inflected forms of a word meet). Every term of the examples is indexed; its weight is
TF-IDF times log(1 + chi-squared), the dependence of its presence on the label over the examples. Inverse document frequencies are counted over all
documents. Norms are over whole texts: a term that no example holds tells nothing of labels (chi-squared 0), so it weighs 0.

The examples are a bounded sample: at most ``EXAMPLES`` labelled texts of each class, those of the least hash of their words. Votes are weighed
by how many labelled texts each example stands for. The index holds, for every term and block of examples, the greatest weight; their sum
bounds all similarities in a block, so blocks are opened in the order of their bounds until the bound falls below the K-th similarity
found. The ``FREQUENT`` terms that most examples hold would fill most postings: their part of all similarities is a product of matrices, for
``TOGETHER`` texts at once, and takes the place of their bounds. The result is that of comparing with every example. Examples bound the size of
the index; no term is left out of it.

A text's raw vote is the share of toxic neighbours, weighed by similarity. The raw votes of the examples, each without itself, are fitted to
their labels by isotonic regression, which makes the score a probability. Evidence names the nearest examples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import MIX, Words, hash_words, mixed, parts, saved, table
from tallyfold.session import bounded_batches

EXAMPLES = 2000
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS = 15
BLOCK = 256
FIRST = 1
FREQUENT = 1024
TOGETHER = 128
EVIDENCE = 3
_NONE = np.empty(0, np.int32)
_TRIM = ".,;:!?\"'()[]{}<>*_-"


def _run_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; ``data`` goes on for eight bytes at least after the last run."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out, some = mixed(size.astype(np.uint64)), np.arange(len(start))
    for a in range(0, int(size.max(initial=0)), 8):
        some = some[size[some] > a]
        spare = (8 * (8 - np.minimum(size[some] - a, 8))).astype(np.uint64)
        out[some] = mixed(out[some] ^ (eight[start[some] + a] << spare)) * MIX
    return out


def terms_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-case words without the signs around them, and of their beginnings, marked as such, and the word of each.

    A word may come to one hash twice: one that ends in the mark. No word holds a line break.
    """
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    bare = pc.ascii_trim(words.view(pa.large_string()), characters=_TRIM).cast(pa.string())
    bare = pc.binary_join(pa.ListArray.from_arrays([0, len(bare)], bare), "\n")[0].as_buffer().to_pybytes()
    lower = bare.decode("utf-8", "ignore").lower().encode()
    data = np.frombuffer(lower + b"\n" + bytes(8), np.uint8)
    # Where characters begin, and of those where lines end: words are counted and cut in characters.
    begin = np.flatnonzero((data[:-8] & 0xC0) != 0x80)
    end = np.flatnonzero(data[begin] == 10)
    first = np.append(0, end[:-1] + 1)
    size = end - first
    given = np.flatnonzero(size)
    whole = hash_words([w for w in lower.split(b"\n") if w])
    marked = np.flatnonzero((data[begin[end[given] - 1]] == 126) & np.isin(size[given] - 1, PREFIXES))
    at, upto = begin[first[given[marked]]], begin[end[given[marked]] - 1]
    whole[marked] = _run_hashes(data, at, upto - at)
    owners, hashes = [given], [whole]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        at = begin[first[longer]]
        owners.append(longer)
        hashes.append(_run_hashes(data, at, begin[first[longer] + n] - at))
    return np.concatenate(hashes), np.concatenate(owners)


class Matcher:
    """The vocabulary's terms in a column of texts. The vocabulary is the sorted hashes of its terms; a term is its place among them."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        # Most words of a large corpus are in no example: few of them are searched for.
        self.bits = np.uint64((1 << 22) - 1)
        self.likely = np.zeros(1 << 22, bool)
        self.likely[vocabulary & self.bits] = True

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all words, one word after the other, and how many each word has."""
        hashes, owner = terms_of(words)
        likely = np.flatnonzero(self.likely[hashes & self.bits])
        hashes, owner = hashes[likely], owner[likely]
        if not len(hashes):
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        place = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == hashes
        key = owner[known] * len(self.vocabulary) + place[known]
        key.sort()
        key = key[np.flatnonzero(np.diff(key, prepend=-1))]
        of = key // len(self.vocabulary)
        return key - of * len(self.vocabulary), np.bincount(of, minlength=len(words))

    def matched(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and counts of all texts, one text after the other, and where each text begins among them."""
        words = Words(column)
        codes, distinct = words.dictionary()
        flat, size = self.of_words(distinct)
        each = size[codes]
        at, _ = stretches((np.cumsum(size) - size)[codes], each)
        width = max(1, len(self.vocabulary))
        key = np.repeat(words.rows() * width, each) + flat[at]
        key.sort()
        head = np.flatnonzero(np.diff(key, prepend=-1))
        count, key = np.diff(head, append=len(key)), key[head]
        first = np.searchsorted(key, np.arange(len(column) + 1) * width)
        return key - np.repeat(np.arange(len(column)) * width, np.diff(first)), count, first

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(term, count) of each text."""
        term, count, first = self.matched(column)
        for a, b in pairwise(first.tolist()):
            yield term[a:b], count[a:b]


def stretches(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all the runs that begin at ``first``, one after the other, and how many each has."""
    end = np.cumsum(size, dtype=np.int64)
    place = np.arange(end[-1] if len(end) else 0)
    place += np.repeat(first - (end - size), size)
    return place, size


def weighted(term: np.ndarray, count: np.ndarray, each: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length, ``each`` being what a term weighs; all 0 where no term weighs anything."""
    w = (1 + np.log(count)) * each[term]
    return w / max(float(np.linalg.norm(w)), 1e-300)


class Index:
    """Examples (term lists and weights) in blocks, with each term's greatest weight in each block; frequent terms are in a matrix instead."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], terms: int):
        # Alike examples share a block: they are ordered by their weightiest terms.
        key = [tuple(term[np.argsort(-weight, kind="stable")][:3].tolist()) for term, weight in examples]
        order = sorted(range(len(examples)), key=lambda i: (key[i] or (terms,), i))
        self.example = np.array(order, np.int64)
        self.blocks = -(-len(order) // BLOCK) or 1
        size = np.array([len(examples[i][0]) for i in order], np.int64)
        term = np.concatenate([np.empty(0, np.int64), *(examples[i][0] for i in order)])
        weight = np.concatenate([np.empty(0), *(examples[i][1] for i in order)])
        at = np.repeat(np.arange(len(order)), size)
        # The row of a frequent term in the matrix; -1 for others. A term of one example is never one.
        held = np.bincount(term, minlength=terms)
        frequent = np.argsort(-held, kind="stable")[:FREQUENT]
        frequent = frequent[held[frequent] > 1]
        self.row = np.full(terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        # Examples without a place are never reached: they fill up the last block.
        self.matrix = np.zeros((len(frequent), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.matrix[self.row[term[dense]], at[dense]] = weight[dense]
        by_term = np.flatnonzero(~dense)[np.argsort(term[~dense], kind="stable")]
        at, term = at[by_term], term[by_term]
        self.at, self.weight = at.astype(np.int32), weight[by_term]
        # A run is the postings of a term in a block; those of a term come one after the other.
        key = term * self.blocks + at // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.run_first = np.append(first, len(key)).astype(np.int32)
        self.run_block = (key[first] % self.blocks).astype(np.int32)
        self.bound = np.maximum.reduceat(self.weight, first) if len(key) else np.empty(0)
        self.runs = np.searchsorted(key[first] // self.blocks, np.arange(terms + 1)).astype(np.int32)

    def by_frequent(self, given: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The part of frequent terms in the cosines of some texts (term, weight) with all examples."""
        rows = np.zeros((len(given), len(self.matrix)))
        for i, (term, weight) in enumerate(given):
            row = self.row[term]
            rows[i, row[row >= 0]] = weight[row >= 0]
        return rows @ self.matrix

    def all_nearest(self, given: Iterable[tuple[np.ndarray, np.ndarray]], leave_out: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for texts in turn; ``leave_out``: the texts are the examples, each is compared with the others."""
        given, i = iter(given), 0
        while some := list(islice(given, TOGETHER)):
            for text, begun in zip(some, self.by_frequent(some), strict=True):
                yield self.nearest(*text, without=i if leave_out else -1, begun=begun)
                i += 1

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the greatest cosine above zero, of equal ones the first, and the cosines. ``begun``: ``by_frequent`` of the text."""
        begun = self.by_frequent([(term, weight)])[0] if begun is None else begun
        first, last = self.runs[term], self.runs[term + 1]
        run, size = stretches(first, last - first)
        w, block = np.repeat(weight, size), self.run_block[run]
        bounds = np.bincount(block, weights=w * self.bound[run], minlength=self.blocks) + begun.reshape(self.blocks, -1).max(axis=1)
        ranked = np.argsort(-bounds, kind="stable")
        names, cosines, worst = np.empty(0, np.int64), np.empty(0), 0.0
        # The best blocks first; what they leave is opened at once.
        for some in (ranked[:FIRST], ranked[FIRST:]):
            opened = np.zeros(self.blocks, bool)
            opened[some] = (bounds[some] > 0) & (bounds[some] >= worst - 1e-8)
            if not opened.any():
                break
            here = np.flatnonzero(opened[block])
            if 2 * len(here) > len(run):  # the postings of a term are one stretch: to open the other blocks too is less work
                posting, size = stretches(self.run_first[first], self.run_first[last] - self.run_first[first])
                value = np.repeat(weight, size)
            else:
                posting, size = stretches(self.run_first[run[here]], self.run_first[run[here] + 1] - self.run_first[run[here]])
                value = np.repeat(w[here], size)
            value *= self.weight[posting]
            score = np.bincount(self.at[posting], weights=value, minlength=len(begun)) + begun
            score[~np.repeat(opened, len(score) // self.blocks)] = 0.0
            if without >= 0:
                score[np.flatnonzero(self.example == without)] = 0.0
            # Of those below the worst so far, or below the k-th here, none is taken.
            least = max(worst, np.partition(score, -k)[-k] if len(score) > k else 0.0) - 1e-8
            hit = np.flatnonzero((score > 0) & (score >= least))
            names, cosines = np.append(names, self.example[hit]), np.append(cosines, np.round(score[hit], 9))
            if len(names) >= k:
                order = np.lexsort((names, -cosines))[:k]
                names, cosines = names[order], cosines[order]
                worst = cosines[-1]
        order = np.lexsort((names, -cosines))[:k]
        return names[order], cosines[order]


def vote(names: np.ndarray, cosines: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray) -> float:
    """The toxic share of the neighbours' weights; -1 without neighbours."""
    w = cosines**2 * stands_for[names]
    return float((w * toxic[names]).sum() / w.sum()) if w.any() else -1.0


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function of least squares, smoothed towards one half by one observation."""
    values, place = np.unique(x, return_inverse=True)
    total, good = np.bincount(place, weights=w), np.bincount(place, weights=w * y)
    pools: list[list[float]] = []
    for i, v in enumerate(values):
        pools.append([v, good[i], total[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, g, t = pools.pop()
            pools[-1][1] += g
            pools[-1][2] += t
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def _candidate_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, toxic): in how many examples of a part, and in how many toxic ones."""
    for batch in parts(batches, "text"):
        words = Words(batch.column("text"))
        codes, distinct = words.dictionary()
        hashes, owner = terms_of(distinct)
        order = np.argsort(owner, kind="stable")
        hashes, size = hashes[order], np.bincount(owner, minlength=len(distinct))
        first = np.cumsum(size) - size
        each = [np.empty(0, np.uint64)]
        for a, b in pairwise(words.first.tolist()):
            word = np.unique(codes[a:b])
            each.append(np.unique(hashes[stretches(first[word], size[word])[0]]))
        toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int64), [len(x) for x in each[1:]])
        found, place, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        bad = np.bincount(place, weights=toxic, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad)], ["term", "n", "toxic"])


class Model:
    """What tasks need: vocabulary, weights, the index of examples and the calibration. Its size is bounded by that of the examples."""

    def __init__(self, docs: DataFrame, labels: DataFrame, examples: int):
        one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("named", F.xxhash64("text"))
        # Texts stay where they are: ids and hashes meet the labels, and only the texts picked are fetched.
        told = texts.select("doc_id", "named").join(one, "doc_id")
        sizes = {int(r[0] > 0): r[1] for r in told.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
        picked = [told.where((F.col("toxic") > 0) == bool(y)).orderBy("named", "doc_id").limit(examples) for y in (0, 1)]
        taken = picked[0].unionAll(picked[1]).groupBy("doc_id", "named").agg(F.count("*").alias("times"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        found = texts.join(F.broadcast(taken), ["doc_id", "named"]).groupBy("doc_id", "named", "toxic", "times").agg(F.first("text").alias("text"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        chosen = saved(found.select("text", "toxic", "doc_id").repartition(12), "examples")
        n, bad = (chosen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first())[:2]
        seen = chosen.select("text", "toxic").mapInArrow(_candidate_terms, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        expected = F.col("n") * (bad / max(n, 1))
        chi = (F.col("toxic") - expected) ** 2 * n / (expected * (n - F.col("n")) * (1 - bad / max(n, 1)) + 1e-9)
        told_of = seen.select("term", chi.alias("chi")).toArrow()
        hashes = told_of["term"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.vocabulary, size = hashes[order], len(hashes)
        shared = docs.sparkSession.sparkContext.broadcast(self.vocabulary)

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, total, rows = Matcher(shared.value), np.zeros(size + 1, np.int64), 0
            for batch in parts(batches, "text"):
                term, _, _ = matcher.matched(batch.column(0))
                total[:size] += np.bincount(term, minlength=size)
                rows += len(batch)
            total[size] = rows
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["term", "n"])

        df = np.zeros(size + 1, np.int64)
        found = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[found["term"].to_numpy()] = found["n"].to_numpy()
        self.weights = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.log1p(told_of["chi"].to_numpy()[order].astype(np.float64))

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in parts(batches, "text"):
                each = list(matcher(batch.column("text")))
                ends = pa.array(np.cumsum([0, *(len(t) for t, _ in each)]).astype(np.int32))
                term, count = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([_NONE, *x]).astype(np.int32))) for x in zip(*each, strict=True))
                yield pa.RecordBatch.from_arrays([term, count, batch.column("toxic"), batch.column("doc_id").cast(pa.string())], ["term", "count", "toxic", "doc_id"])

        rows = chosen.mapInArrow(vectors, "term array<int>, count array<int>, toxic int, doc_id string").toArrow().sort_by("doc_id").combine_chunks()
        shared.unpersist()
        self.toxic = rows["toxic"].to_numpy().astype(np.float64)
        self.names = rows["doc_id"].to_pylist()
        share = [sizes.get(y, 0) / max(1, int((self.toxic == y).sum())) for y in (0, 1)]
        self.stands_for = np.where(self.toxic > 0, share[1], share[0])
        given = [(t.values.to_numpy().astype(np.int64), c.values.to_numpy()) for t, c in zip(rows["term"], rows["count"], strict=True)]
        examples_ = [(t, weighted(t, c, self.weights)) for t, c in given]
        self.index = Index(examples_, size)
        raw = np.array([vote(*found, self.toxic, self.stands_for) for found in self.index.all_nearest(examples_, leave_out=True)])
        scale = len(raw) / self.stands_for.sum() if len(raw) else 1.0
        self.knots, self.levels = isotonic(raw, self.toxic, self.stands_for * scale) if len(raw) else (np.array([-1.0]), np.array([0.5]))


def calibrated(raw: float, knots: np.ndarray, levels: np.ndarray) -> float:
    return float(levels[max(0, np.searchsorted(knots, raw + 1e-12, side="right") - 1)])


def scored(docs: DataFrame, training: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``docs`` without text, with score (double), predicted (int) and evidence (array of the nearest examples).

    ``training`` (doc_id, text) are the rows that labels may be learned from. NULL and empty texts and those without a term of any example have no
    neighbour: their score is the calibrated share of such examples. Without any label every score is 0.5. Repeated rows are scored
    alike; contrary labels of an id count as toxic. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    model_of = docs.sparkSession.sparkContext.broadcast(vars(Model(training, labels, examples)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        toxic, stands_for, doc_ids = model["toxic"], model["stands_for"], model["names"]
        matcher, index = Matcher(model["vocabulary"]), model["index"]
        for batch in parts(batches, "text"):
            scores, evidence = [], []
            texts = ((term, weighted(term, count, model["weights"])) for term, count in matcher(batch.column("text")))
            for names, cosines in index.all_nearest(texts):
                scores.append(calibrated(vote(names, cosines, toxic, stands_for), model["knots"], model["levels"]))
                evidence.append([{"doc_id": doc_ids[i], "similarity": float(c), "toxic": int(toxic[i])} for i, c in zip(names[:EVIDENCE].tolist(), cosines.tolist(), strict=False)])
            columns = [x for x in batch.schema.names if x != "text"]
            kind = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)], names=[*columns, "score", "predicted", "evidence"])

    rest = docs.drop("score", "predicted", "evidence")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text")
    return rest.mapInArrow(score, f"{kinds}, score double, predicted int, evidence array<struct<doc_id: string, similarity: double, toxic: int>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; a fifth of the ids is held out of training."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return scored(docs, docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
