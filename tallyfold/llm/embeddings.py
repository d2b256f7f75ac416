"""Near-duplicate vectors by spherical-cap filters with exact verification.

A filter is a direction; a vector belongs to all filters whose direction it exceeds ``alpha`` with. Vectors at a small angle share
filters, others hardly do. The directions form structured random product codes: the coordinates are cut into two blocks, each block has B
random unit directions, and each pair of them is a filter. So B * B filters need only 2 * B products a vector, and the filters exceeded are
listed from the greatest products without visiting the others.

There are ``CODES`` codes, each behind a random rotation of its own, so that it does not matter which coordinates hold a vector's weight. A pair is
lost only if it shares no filter in any of them. Each code may then lose many pairs, and so have a high ``alpha`` and few filters a vector: twelve
codes list 64 filters for a vector where one code of the same recall lists 209, and compare it with 85 vectors where that compares it with 10,948 (51,282 vectors of
length 64).

B follows the number of vectors, so that a filter's share of them stays small. ``alpha`` is the greatest value at which simulated pairs at
exactly the linking cosine are found by all codes together with a probability of ``RECALL``; closer pairs are found more surely.

Equal vectors are one node with a weight. Filters with over ``CHUNK`` vectors are cut into chunks and each pair of chunks is a unit of work of
its own. A pair is counted in the least filter it shares, so no list of pairs is made: units give a count for each vector and, for the
components, at most one edge for each vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import components, least_linked, saved, seeded, table

COSINE = 0.9
RECALL = 0.9995
CODES = 12
CHUNK = 1024
#: Directions of the second block that are looked at first for a vector; all of them where these do not reach.
_BEST = 48


class Code:
    """The product codes for vectors of one length."""

    def __init__(self, length: int, side: int, cosine: float):
        self.size = side * side
        self.codes = [_OneCode(length, side, cosine, i) for i in range(CODES)]

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each vector; in each code the best one if it exceeds none."""
        found = [code.filters(unit) for code in self.codes]
        owner = np.concatenate([x for x, _ in found])
        name = np.concatenate([f + i * self.size for i, (_, f) in enumerate(found)])
        order = np.lexsort((name, owner))
        return np.split(name[order], np.searchsorted(owner[order], np.arange(1, len(unit))))


class _OneCode:
    """A product code and the threshold of its filters."""

    def __init__(self, length: int, side: int, cosine: float, number: int):
        random = seeded(f"product code {length} {side} {number}")
        turned, upper = np.linalg.qr(seeded(f"rotation {length} {number}").standard_normal((length, length)))
        self.rotation = turned * np.where(np.diag(upper) < 0, -1.0, 1.0)
        self.cut = length - length // 2
        self.side = side
        self.blocks = []
        for width in (self.cut, length - self.cut):
            block = random.standard_normal((side, max(1, width)))[:, :width]
            self.blocks.append(block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12) / math.sqrt(2))
        pairs = 4000
        a = random.standard_normal((pairs, length))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = random.standard_normal((pairs, length))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
        b = cosine * a + math.sqrt(max(0, 1 - cosine * cosine)) * b
        both = []
        for x, y in zip(self.products(a), self.products(b), strict=True):
            top = np.argsort(-(x + y), axis=1)[:, :64]
            both.append((np.take_along_axis(x, top, 1), np.take_along_axis(y, top, 1)))
        (x1, y1), (x2, y2) = both
        best = [np.minimum(x1[i][:, None] + x2[i], y1[i][:, None] + y2[i]).max() for i in range(pairs)]
        self.alpha = float(np.quantile(best, (1 - RECALL) ** (1 / CODES)))

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        unit = unit @ self.rotation
        return [unit[:, : self.cut] @ self.blocks[0].T, unit[:, self.cut :] @ self.blocks[1].T]

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all filters exceeded, the best one of a vector that exceeds none."""
        one, two = self.products(unit)
        top = two.max(axis=1)
        # Nothing but the products at its row's threshold can be part of a filter; the best one always is.
        least = np.minimum(self.alpha, one.max(axis=1) + top) - 1e-12
        row, first = np.nonzero(one >= (least - top)[:, None])
        need = least[row] - one[row, first]
        width = min(_BEST, self.side)
        while True:
            ranked = np.argpartition(-two, width - 1, axis=1)[:, :width] if width < self.side else np.tile(np.arange(self.side), (len(unit), 1))
            values = np.take_along_axis(two, ranked, axis=1)
            hit = values[row] >= need[:, None]
            if width == self.side or not hit.all(axis=1).any():
                break
            width = self.side
        pair, column = np.nonzero(hit)
        return row[pair], first[pair] * self.side + ranked[row[pair], column]


def _nodes(kind: str):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, node, vector): a digest of the components, and their bytes; NULL where a vector links with nothing."""
        import xxhash

        for batch in batches:
            nodes, vectors = [], []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    vectors.append(None)
                else:
                    vectors.append((x + 0).tobytes())  # -0.0 becomes 0.0
                    nodes.append(xxhash.xxh3_128_digest(vectors[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "node", "vector"])

    return name


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _filtered(kind: str, side: int, cosine: float, vectors: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            nodes, raws, weights = (batch.column(c).to_pylist() for c in ("node", "vector", "n"))
            lengths = np.array([len(x) // np.dtype(kind).itemsize for x in raws], np.int64)
            for length in np.unique(lengths).tolist():
                code = codes.get(length) or codes.setdefault(length, Code(length, side, cosine))
                at = np.flatnonzero(lengths == length)
                for part in np.array_split(at, -(-len(at) // 512)):
                    found = code.filters(_unit(np.frombuffer(b"".join(raws[i] for i in part), kind).reshape(len(part), length)))
                    size = np.array([len(x) for x in found])
                    names = pa.array(np.concatenate(found) + length * CODES * side * side)
                    if not vectors:
                        yield pa.RecordBatch.from_arrays([names], ["filter"])
                        continue
                    owner = pa.array(np.repeat(np.arange(len(part)), size))
                    columns = [pa.array([nodes[i] for i in part], pa.binary()), pa.array([weights[i] for i in part], pa.int64()), pa.array([raws[i] for i in part], pa.binary()), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays([names, *(c.take(owner) for c in columns)], ["filter", "node", "n", "vector", "filters"])

    return decode


def _compared(kind: str, side: int, cosine: float):
    def unit_of_work(rows: list[dict], left: int, right: int, filter_: int) -> Iterator[tuple]:
        """(node, n, root) of the vectors of a unit: n links counted here, root a vector it is connected with."""
        raw = [np.frombuffer(r["vector"], kind) for r in rows]
        chunk = np.array([r["chunk"] for r in rows])
        unit = _unit(np.stack(raw))
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        if left != right:
            linked &= chunk[:, None] != chunk[None, :]
        if not linked.any():
            return
        own = filter_ % (CODES * side * side)
        lists = [np.frombuffer(r["filters"], "<i4") for r in rows]
        lower = [x[x < own] for x in lists]
        names, inverse, count = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in lower])
        shared = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        earlier = np.zeros((len(rows), len(rows)), bool)
        width = int((count > 1).sum())
        for a in range(0, width, 4096):
            in_part = use & (shared[inverse] >= a) & (shared[inverse] < a + 4096)
            has = np.zeros((len(rows), min(4096, width - a)), np.float32)
            has[owner[in_part], shared[inverse[in_part]] - a] = 1
            earlier |= has @ has.T > 0
        here = linked & ~earlier
        weights = np.array([r["n"] for r in rows], np.float64)
        links, root = (here @ weights).astype(np.int64), least_linked(linked)
        for i in np.flatnonzero((links > 0) | (root != np.arange(len(rows)))).tolist():
            yield rows[i]["node"], int(links[i]), rows[root[i]]["node"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit may go on in the next batch."""
        kept: list[dict] = []
        key = None

        def done() -> pa.RecordBatch:
            found = list(unit_of_work(kept, key[1], key[2], key[0])) if len(kept) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["node", "n", "root"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("filter", "g", "h")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in pairwise(edges):
                here = tuple(keys[a].tolist())
                if here != key:
                    if len(kept) > 1:
                        yield done()
                    kept, key = [], here
                if kept or b - a > 1 or b == len(batch):
                    kept.extend(batch.slice(a, b - a).to_pylist())
        if len(kept) > 1:
            yield done()

    return compare


def side_of(vectors: int) -> int:
    """Directions a block: about four filters for each vector, 4,096 to 16 million of them."""
    return max(64, min(4096, math.ceil(math.sqrt(4 * vectors))))


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) for each row of ``vectors`` (vec_id, embedding, anything else).

    Vectors that are NULL, empty, zero or hold NULL or non-finite numbers link with nothing, and so do vectors of different lengths. Repeated
    rows are vectors of their own. A row whose vec_id is NULL counts as a link; a component of such rows only has a NULL id. An empty table
    stays empty.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    raw = vectors.select("vec_id", "embedding") if kind == "<f4" else vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = dict(vectors.dtypes)["vec_id"]
    named = raw.mapInArrow(_nodes(kind), f"vec_id {id_type}, node binary, vector binary")
    nodes = saved(named.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vectors")
    side = side_of(nodes.count())
    sizes = nodes.select("node", "vector", "n").mapInArrow(_filtered(kind, side, cosine, False), "filter long").groupBy("filter").agg(F.count("*").alias("size"))
    large = saved(sizes.where(F.col("size") > CHUNK).select("filter", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "large")
    rows = nodes.select("node", "vector", "n").mapInArrow(_filtered(kind, side, cosine, True), "filter long, node binary, n long, vector binary, filters binary")
    dealt = rows.join(large, "filter", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("other", other).withColumn("g", F.least("chunk", "other")).withColumn("h", F.greatest("chunk", "other"))
    dealt = dealt.select("filter", "g", "h", "chunk", "node", "n", "vector", "filters").repartition("filter", "g", "h").sortWithinPartitions("filter", "g", "h")
    found = saved(dealt.mapInArrow(_compared(kind, side, cosine), "node binary, n long, root binary"), "links")
    counts = saved(found.groupBy("node").agg(F.sum("n").alias("links")), "counts")
    roots = saved(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    placed = saved(nodes.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    ids = saved(placed.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    per_node = saved(placed.join(ids, "root").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "per_node")
    out = named.select("vec_id", "node").join(per_node, "node", "left")
    alone = F.col("n_links").isNull()
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every vector, and its component."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embeddings": op1_embeddings}
ORACLE = {
    "op1_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""
}
