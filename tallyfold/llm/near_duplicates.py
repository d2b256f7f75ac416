"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is the multiset of its runs of five words. The weight of a shingle is its count times its inverse document frequency, the mean of
those of its five words. Word frequencies are counted over all documents, by ``FEATURES`` hashed features, so that the table a task needs
has a fixed size; common words decide a feature's frequency, rare ones share it without harm. (The frequency of whole shingles would
rank the shingles of a group of copies as common, and so make a copy less like its group the larger the group is.)

Each sample of a text keeps a shingle with a probability in proportion to its weight, so two texts agree on a sample with the
probability of their weighted Jaccard similarity. ``ROWS`` samples make a band; texts that share a band are candidates.

Equal texts are one class from the start. The members of a band are compared with its central one, that which shares most bands with
others. Where a band's members are then still in different components, all of them are compared within tasks, in blocks of ``CHUNK`` texts by
products of sparse rows, and each gives one link at most. So every candidate pair is verified or connected, no list of pairs is made, and
nothing is capped.

Before any text moves, the samples themselves (16 bits of each) tell how alike two texts are: a pair of which fewer than ``AGREE`` of the 36 samples
agree is at the threshold with a probability below 1e-7, and its texts are not fetched. A text that many are compared with is sent once for
every ``CHUNK`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Words, among, components, grams, least_linked, mixed, parts, saved, seeded, table, text_hash
from tallyfold.session import bounded_batches

SHINGLE = 5
SIMILARITY = 0.8
#: 12 bands of 3: a pair at the threshold is found with a probability of 0.9998.
BANDS, ROWS = 12, 3
FEATURES = 1 << 17
_DRAWS = 1 << 16
CHUNK = 512
#: Samples that agree in a pair whose texts are compared. At a similarity of 0.8, 14 or fewer of 36 agree with a probability of 6e-8.
AGREE = 15
ROUNDING = 1e-9


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of rows with a word of each feature, and of all rows with a word. Always FEATURES numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in parts(batches, "text"):
            words = Words(batch.column("text"))
            feature = (words.hashes() % np.uint64(FEATURES)).astype(np.int64)
            pairs = np.unique(words.rows() * FEATURES + feature)
            total += np.bincount(pairs % FEATURES, minlength=FEATURES)
            rows += int((np.diff(words.first) > 0).sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], ["feature", "n"])

    found = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def inverse_frequencies(df: np.ndarray, rows: int) -> np.ndarray:
    """Smoothed, and above zero also for a word of every document."""
    return (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)


def counted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of a text, sorted, their inverse frequencies and counts. A text of one to four words is one shingle."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
    each = idf[(hashes % np.uint64(len(idf))).astype(np.int64)].astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(each)])
    names, place, count = np.unique(grams(hashes, n), return_index=True, return_counts=True)
    # The mean depends on the shingle alone, not on where it stands: sums are rounded.
    return names, np.round((sums[place + n] - sums[place]) / n, 3), count


def weighted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, sorted, and their weights."""
    names, each, count = counted(hashes, idf)
    return names, each * count


class Sampler:
    """Consistent weighted samples. The random draws of a shingle come from tables that its hash points into."""

    def __init__(self, samples: int):
        random = seeded("consistent weighted sampling")
        self.r = random.gamma(2, 1, _DRAWS).astype(np.float32)
        self.beta = random.random(_DRAWS, dtype=np.float32)
        self.log_c = np.log(random.gamma(2, 1, _DRAWS * 16)).astype(np.float32)
        self.odd = random.integers(0, 1 << 63, samples, np.uint64) | np.uint64(1)
        self.samples = samples

    def __call__(self, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value a sample: of the shingle taken and its quantised weight."""
        logs, best, taken = np.log(weights).astype(np.float32), np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        for a in range(0, len(names), 2048):
            name, log = names[a : a + 2048], logs[a : a + 2048]
            draw = name[None, :] * self.odd[:, None]
            draw ^= draw >> np.uint64(29)
            r = self.r[(draw & np.uint64(0xFFFF)).astype(np.intp)]
            beta = self.beta[((draw >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
            level = np.floor(log / r + beta)
            score = self.log_c[(draw >> np.uint64(44)).astype(np.intp)] - r * (level - beta + 1)
            at = score.argmin(axis=1)
            every = np.arange(self.samples)
            low = score[every, at]
            better = low < best
            value = mixed(name[at] + level[every, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            best[better], taken[better] = low[better], value[better]
        return taken


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the lesser weights over that of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def _banded(idf_of):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, bands, samples): none for a text without words."""
        idf, sampler = idf_of.value, Sampler(BANDS * ROWS)
        for batch in parts(batches, "text"):
            words = Words(batch.column("text"))
            hashes, first = words.hashes(), words.first.tolist()
            bands, drawn = [], []
            for a, b in zip(first, first[1:], strict=False):
                if a == b:
                    bands.append([])
                    drawn.append([])
                    continue
                samples = sampler(*weighted(hashes[a:b], idf)).reshape(BANDS, ROWS)
                drawn.append(samples.ravel().astype(np.uint16).view(np.int16).tolist())
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for i in range(ROWS):
                    key = mixed(key ^ samples[:, i])
                bands.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(bands, pa.list_(pa.int64())), pa.array(drawn, pa.list_(pa.int16()))], ["name", "bands", "samples"])

    return sign


def _verified(idf_of, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs of texts (a, text_a, b, text_b) those that are similar: (a, b)."""
        idf = idf_of.value
        for batch in parts(parts(batches, "text_a"), "text_b"):
            known: dict[str, tuple] = {}
            kept = np.zeros(len(batch), bool)
            names = [batch.column(x).to_pylist() for x in ("a", "b")]
            sides = [Words(batch.column(x)) for x in ("text_a", "text_b")]
            hashed = [x.hashes() for x in sides]
            for i in range(len(batch)):
                both = []
                for side in (0, 1):
                    name, first = names[side][i], sides[side].first
                    if name not in known:
                        known[name] = weighted(hashed[side][first[i] : first[i + 1]], idf)
                    both.append(known[name])
                kept[i] = similarity(*both) >= least - ROUNDING
            keep = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return verify


def all_similar(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which texts (as ``counted``) are similar, as a matrix.

    Counts are laid out as levels (a shingle that comes twice has two), so the sum of lesser weights is a product of zero-one rows.
    """
    owner = np.repeat(np.arange(len(texts)), [int(c.sum()) for _, _, c in texts])
    names, weight = [], []
    for name, each, count in texts:
        level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        names.append(np.repeat(name, count) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        weight.append(np.repeat(each, count))
    feature, inverse, n = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    weight = np.concatenate(weight)
    total = np.bincount(owner, weights=weight, minlength=len(texts))
    place, use = np.cumsum(n > 1) - 1, n[inverse] > 1
    owner, column, weight = owner[use], place[inverse[use]], weight[use]
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    shared, width = np.zeros((len(texts), len(texts))), int((n > 1).sum())
    for a in range(0, width, 2048):
        i, j = np.searchsorted(column, [a, a + 2048])
        has = np.zeros((len(texts), min(2048, width - a)))
        has[owner[i:j], column[i:j] - a] = np.sqrt(weight[i:j])
        shared += has @ has.T
    both = total[:, None] + total[None, :] - shared
    similar = shared >= (least - ROUNDING) * both
    np.fill_diagonal(similar, True)  # a text's own shingles are left out above
    return similar


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit (bucket, g, h), which may go on in the next batch: those whose samples agree with a text of another component."""
    key, kept = None, []

    def done() -> list[dict]:
        samples, root = np.array([r["samples"] for r in kept], np.int16), np.unique([r["root"] for r in kept], return_inverse=True)[1]
        agree = np.zeros((len(kept), len(kept)), np.uint8)
        for s in samples.T:
            agree += s[:, None] == s[None, :]
        near = (agree >= AGREE) & (root[:, None] != root[None, :])
        return [{c: r[c] for c in _UNIT.names} for r, x in zip(kept, near.any(axis=1).tolist(), strict=True) if x]

    for batch in batches:
        for row in batch.to_pylist():
            here = (row["bucket"], row["g"], row["h"])
            if here != key:
                if len(kept) > 1:
                    yield pa.RecordBatch.from_pylist(done(), _UNIT)
                key, kept = here, []
            kept.append(row)
    if len(kept) > 1:
        yield pa.RecordBatch.from_pylist(done(), _UNIT)


_UNIT = pa.schema([("bucket", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("chunk", pa.int32()), ("name", pa.string()), ("root", pa.string())])


def _blocks(idf_of, least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit (bucket, g, h), which may go on in the next batch: a link (a, b) for each text that has one."""
        idf, key, kept = idf_of.value, None, []

        def done() -> pa.RecordBatch:
            names, roots, chunks = [r[0] for r in kept], np.array([r[1] for r in kept]), np.array([r[2] for r in kept])
            linked = all_similar([r[3] for r in kept], least)
            open_ = roots[:, None] != roots[None, :]
            if key[1] != key[2]:
                open_ &= chunks[:, None] != chunks[None, :]
            root = least_linked(linked & open_)
            at = np.flatnonzero(root != np.arange(len(root))).tolist()
            return pa.RecordBatch.from_arrays([pa.array([names[root[i]] for i in at], pa.string()), pa.array([names[i] for i in at], pa.string())], ["a", "b"])

        for batch in parts(batches, "text"):
            words = Words(batch.column("text"))
            hashes, first = words.hashes(), words.first
            columns = [batch.column(c).to_pylist() for c in ("bucket", "g", "h", "name", "root", "chunk")]
            for i, (bucket, g, h, name, root, chunk) in enumerate(zip(*columns, strict=True)):
                if (bucket, g, h) != key:
                    if len(kept) > 1:
                        yield done()
                    key, kept = (bucket, g, h), []
                kept.append((name, root, chunk, counted(hashes[first[i] : first[i + 1]], idf)))
        if len(kept) > 1:
            yield done()

    return compare


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(text_hash, root): the texts with at least one word, and the least text of the component each is in.

    Components are those of the verified links. ``docs`` needs ``text``; other columns do not matter. NULL, empty and all-space texts
    are in no class. Repeated rows and copies are one text. An empty table has no class.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(text_hash().alias("name"), "text").where("text is not null")
    idf_of = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs)))
    signed = texts.mapInArrow(_banded(idf_of), "name string, bands array<long>, samples array<short>").groupBy("name").agg(F.first("bands").alias("bands"), F.first("samples").alias("samples"))
    signed = saved(signed.where(F.size("bands") > 0), "signed")
    members = signed.select("name", F.posexplode("bands").alias("band", "key"))
    sizes = saved(members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = saved(members.join(sizes, ["band", "key"]).select("band", "key", "name", "n"), "shared")
    involved = saved(shared.groupBy("name").agg(F.sum("n").alias("shares")), "involved")
    central = shared.join(involved, "name").groupBy("band", "key").agg(F.max(F.struct("shares", "name")).alias("top")).select("band", "key", F.col("top.name").alias("lead"))
    met = shared.join(saved(central, "central"), ["band", "key"]).where("name <> lead").groupBy(F.col("lead").alias("a"), F.col("name").alias("b")).agg(F.max("n").alias("n"))
    pairs = saved(met.select("a", "b", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")), "pairs")

    def beside(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
        """``pairs`` with the ``column`` of both texts. The row of a text that many are compared with is repeated for each chunk of them."""
        leads = pairs.groupBy("a").agg(F.max("chunks").alias("chunks"))
        each = rows.withColumnRenamed("name", "a").join(leads, "a").select("a", F.col(column).alias(f"{column}_a"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        return pairs.join(rows.select(F.col("name").alias("b"), F.col(column).alias(f"{column}_b")), "b").join(each, ["a", "chunk"])

    def bodies(names: DataFrame) -> DataFrame:
        """(name, text), one row a text; copies are merged before and after the shuffle, and what is not asked for is not shuffled."""
        names = saved(names.distinct(), "names")
        near = among(texts, "name", names, "name")
        return saved(near.join(names, "name", "left_semi").groupBy("name").agg(F.first("text").alias("text")), "bodies")

    agreeing = F.aggregate(F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    close = saved(beside(pairs, signed.select("name", "samples"), "samples").where(agreeing >= AGREE).select("a", "b", "chunks", "chunk"), "close")
    compared = beside(close, bodies(close.select(F.col("a").alias("name")).unionAll(close.select("b"))), "text")
    links = saved(compared.select("a", "text_a", "b", "text_b").mapInArrow(_verified(idf_of, least), "a string, b string"), "links")
    roots = saved(components(links), "roots")
    placed = saved(shared.join(roots.withColumnRenamed("node", "name"), "name", "left").select("band", "key", "name", "n", F.coalesce("root", "name").alias("root")), "placed")
    # Bands of two have had their one comparison. Bands of the same members are looked at once.
    same = placed.where("n > 2").groupBy("band", "key").agg(F.first("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("name").cast("decimal(20,0)")).alias("members"))
    same = same.where("low < high").groupBy("n", "members").agg(F.min(F.struct("band", "key")).alias("one")).select("one.band", "one.key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    open_ = saved(placed.join(saved(same, "same"), ["band", "key"]), "open")
    final = roots
    if not open_.isEmpty():
        cut = open_.withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        units = cut.select(F.concat_ws(":", "band", "key").alias("bucket"), F.least("chunk", "other").cast("int").alias("g"), F.greatest("chunk", "other").cast("int").alias("h"), "chunk", "name", "root")
        drawn = units.join(signed.select("name", "samples"), "name").repartition("bucket", "g", "h").sortWithinPartitions("bucket", "g", "h")
        units = saved(drawn.select(*_UNIT.names, "samples").mapInArrow(_promising, "bucket string, g int, h int, chunk int, name string, root string"), "promising")
        units = units.join(bodies(units.select("name")), "name").repartition("bucket", "g", "h").sortWithinPartitions("bucket", "g", "h")
        more = saved(units.mapInArrow(_blocks(idf_of, least), "a string, b string"), "more")
        if not more.isEmpty():
            final = saved(components(links.unionAll(more)), "roots")
    return signed.select("name").join(final.withColumnRenamed("node", "name"), "name", "left").select(F.col("name").alias("text_hash"), F.coalesce("root", "name").alias("root"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, text_hash_too: bool = False) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs``: class_id is the least doc_id of its class, kept the row that stays.

    A text without words is a class of its own. Of rows that share the least doc_id of a class one is kept. NULL ids come after all
    others: a class of NULL ids has a NULL class_id, and one of its rows is kept.
    """
    rows = docs.select("doc_id", text_hash().alias("text_hash"))
    out = _marked(rows, classes(docs, least))
    return out if text_hash_too else out.drop("text_hash")


def _marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, ...) with class_id and kept."""
    found = saved(found, "classes")
    per_text = saved(rows.join(found, "text_hash").groupBy("root").agg(F.min("doc_id").alias("class_id")), "class_ids")
    of_text = saved(found.join(per_text, "root"), "texts")
    joined = rows.join(of_text, "text_hash", "left")
    # The row that stays: the first of those with the class's id, by a number that tells equal rows apart.
    numbered = saved(joined.withColumn("_n", F.monotonically_increasing_id()), "numbered")
    stays = numbered.where("root is not null and doc_id <=> class_id").groupBy("root").agg(F.min("_n").alias("_stay"))
    out = numbered.join(saved(stays, "stays").withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left")
    alone = F.col("root").isNull()
    return out.withColumn("kept", alone | (F.col("_n") == F.coalesce("_stay", F.lit(-1)))).withColumn("class_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))).drop("_n", "_stay", "_root", "root")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each class, and every row without words.

    Only ids and digests are marked; the texts meet them once. Repeated rows are rare, so they alone are merged by a shuffle.
    """
    marked = saved(near_duplicates(docs, least, text_hash_too=True), "marked")
    gone = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")).where("stay < n")
    gone = saved(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "stay"), "gone")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.col("text_hash").eqNullSafe(F.col("gone_hash"))
    whole = rows.join(gone, same, "left_anti").select("row.*")
    one = gone.where("stay > 0")
    if one.isEmpty():
        return whole
    return whole.unionByName(rows.join(one, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLE: dict[str, str] = {}
