"""Language of texts by fusing evidence: the text, its declared language, its address suffix and its host.

* Text: likelihoods of byte trigrams (hashed, smoothed), counted for each language over all labelled texts. A long text is no more certain than
  ``LENGTH`` trigrams of its average likelihood. A background of equal likelihoods stands for text of no language.
* Declared language: how often each declaration goes with each language, from the texts' own posteriors.
* Host: a prior smoothed up a hierarchy. A host's mix of languages leans on that of its domain, that on its suffix, that on all rows; each
  level counts as ``LEAN`` rows of the level above. A row's own posterior is taken out of its host's sums first.

The sums of all levels are grouped aggregations of posteriors; hosts and declarations are joined, never collected. Only the trigram
table, of a fixed size, goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyfold.llm.common import parts, saved, table, text_hash

LANGUAGES = ("de", "en", "es", "fr")
FEATURES = 1 << 15
LENGTH = 100
LEAN = 5.0
#: Prior share of texts of no language, and the posterior that a language needs.
NONE_SHARE = 0.01
CONFIDENCE = 0.5


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes (A-Z folded, each run of other ASCII than letters as one space) and where each row begins and ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers, n = column.buffers(), len(column)
    at = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    at = at - at[0]
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    data = fold[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    starts = at[:-1][at[:-1] < len(data)]
    keep[starts] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all rows, one after the other, and how many each row has. A row without letters has none."""
    data, at = _bytes_of(column)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(at) - 1, np.int64)
    code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    inside = row[:-2] == row[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)[inside], np.bincount(row[:-2][inside], minlength=len(at) - 1)


def trained(labelled: DataFrame, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log likelihoods (language, feature) from all rows of (text, lang); rows of other languages or none are left out."""
    languages = list(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * FEATURES, np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in parts(batches, "text"):
            feature, size = trigrams(batch.column(0))
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            total += np.bincount(np.repeat(lang, size) * FEATURES + feature, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    rows = labelled.where(F.col("lang").isin(languages)).select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.full(len(languages) * FEATURES, 0.1)
    cells[rows["cell"].to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    cells = cells.reshape(len(languages), FEATURES)
    return np.log(cells / cells.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(table_of):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The columns but ``text``, with ``text_score``: log likelihood of each language and of none; NULL without trigrams."""
        model = table_of.value
        for batch in parts(batches, "text"):
            feature, size = trigrams(batch.column("text"))
            first = np.concatenate([[0], np.cumsum(size)])
            some = size > 0
            scores = np.zeros((len(size), len(model) + 1))
            for i, each in enumerate(model):
                total = np.concatenate([[0.0], np.cumsum(each[feature], dtype=np.float64)])
                scores[:, i] = total[first[1:]] - total[first[:-1]]
            scores[:, -1] = -np.log(FEATURES) * size
            scores *= (np.minimum(size, LENGTH) / np.maximum(size, 1))[:, None]
            out = pa.array([x if ok else None for x, ok in zip(scores.tolist(), some.tolist(), strict=True)], pa.list_(pa.float64()))
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), out], names=[*names, "text_score"])

    return score


def _with_shares(df: DataFrame, logs: list[Column], name: str) -> DataFrame:
    """``df`` with the softmax of ``logs`` as columns ``name0``, ``name1``, ...

    Step by step, each on columns of the step before: written as one expression it would repeat all of its inputs at every use.
    """
    every = range(len(logs))
    df = df.select("*", *(x.alias(f"_log{i}") for i, x in enumerate(logs)))
    df = df.withColumn("_top", F.greatest(*(F.col(f"_log{i}") for i in every)))
    df = df.select("*", *(F.exp(F.col(f"_log{i}") - F.col("_top")).alias(f"_part{i}") for i in every))
    df = df.withColumn("_total", reduce(lambda a, b: a + b, [F.col(f"_part{i}") for i in every]))
    df = df.select("*", *((F.col(f"_part{i}") / F.col("_total")).alias(f"{name}{i}") for i in every))
    return df.drop("_top", "_total", *(f"_log{i}" for i in every), *(f"_part{i}" for i in every))


def _with_best(df: DataFrame, languages: Sequence[str], shares: str, name: str, top: str) -> DataFrame:
    """``df`` with the language of the greatest share (the first of equal ones) as ``name`` and that share as ``top``."""
    each = [F.col(f"{shares}{i}") for i in range(len(languages))]
    df = df.withColumn(top, F.greatest(*each))
    return df.withColumn(name, F.coalesce(*(F.when(s >= F.col(top), F.lit(x)) for x, s in zip(languages, each, strict=True))))


def identified(rows: DataFrame, model: np.ndarray, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``rows`` (text, declared, host, anything else but p0, p1, ..., q0, ..., domain) without text, with suffix, text_lang, lang,
    confidence and accepted.

    A text without a trigram (NULL, empty, no letters) is of no language: lang is ``und``, confidence 0, not accepted. A NULL or empty
    declaration or host is a value like any other: it says what it says on average. Repeated rows are rows of their own. An
    empty table stays empty.
    """
    n, every = len(languages), range(len(languages) + 1)
    names = [*languages, "und"]
    clean = rows.withColumn("declared", F.coalesce(F.lower("declared"), F.lit(""))).withColumn("host", F.coalesce(F.lower("host"), F.lit("")))
    schema = StructType([*clean.drop("text").schema.fields, StructField("text_score", ArrayType(DoubleType()))])
    scored = clean.mapInArrow(_likelihoods(rows.sparkSession.sparkContext.broadcast(model)), schema)
    labels = F.split("host", r"\.")
    scored = scored.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), "suffix")).otherwise(F.col("host")))
    text = [F.col("text_score")[i] for i in every]
    logs = [*(text[i] + float(np.log((1 - NONE_SHARE) / n)) for i in range(n)), text[n] + float(np.log(NONE_SHARE))]
    scored = _with_shares(scored, logs, "_share")
    shares = [f"_share{i}" for i in every]
    scored = saved(scored.select("*", *(F.coalesce(s, F.lit(0.0)).alias(f"p{i}") for i, s in enumerate(shares))).drop(*shares), "text_scores")

    def sums(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in every))

    hosts = saved(sums(scored, "suffix", "domain", "host"), "hosts")
    domains = sums(hosts, "suffix", "domain")
    suffixes = sums(domains, "suffix")
    whole = [x or 0.0 for x in sums(suffixes).first()]
    base = [(x + 1) / (sum(whole) + n + 1) for x in whole]

    def leaning(df: DataFrame, above: DataFrame | None, on: list[str]) -> DataFrame:
        """Each row's shares q, leaning on those of the level above."""
        total = reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in every])
        joined = df.select(*on, *(f"p{i}" for i in every), *(F.lit(base[i]).alias(f"q{i}") for i in every)) if above is None else df.join(above, on[:-1])
        return joined.select(*on, *((F.col(f"p{i}") + LEAN * F.col(f"q{i}")).alias(f"n{i}") for i in every), total.alias("total")).select(
            *on, *((F.col(f"n{i}") / (F.col("total") + LEAN)).alias(f"q{i}") for i in every)
        )

    domain_mix = leaning(domains, leaning(suffixes, None, ["suffix"]), ["suffix", "domain"])
    of_host = hosts.join(domain_mix, ["suffix", "domain"]).select(F.col("host").alias("_host"), *(F.col(f"p{i}").alias(f"h{i}") for i in every), *(f"q{i}" for i in every))
    said = saved(sums(scored, "declared"), "declared")
    kinds = said.count()
    of_declared = said.select(F.col("declared").alias("_declared"), *(F.log((F.col(f"p{i}") + 0.5) / (whole[i] + 0.5 * (kinds + 1))).alias(f"d{i}") for i in every))
    joined = scored.join(saved(of_host, "host_mix"), F.col("host") == F.col("_host")).join(saved(of_declared, "declared_mix"), F.col("declared") == F.col("_declared"))
    prior = [F.log((F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) + LEAN * F.col(f"q{i}") + 1e-9)) for i in every]
    out = _with_shares(joined, [text[i] + F.col(f"d{i}") + prior[i] for i in every], "_fused")
    out = _with_best(_with_best(out, names, "_fused", "_lang", "_sure"), names, "p", "_text_lang", "_text_sure")
    known = F.col("text_score").isNotNull()
    out = out.withColumn("text_lang", F.when(known, F.col("_text_lang")).otherwise(F.lit("und")))
    out = out.withColumn("_lang", F.when(known, F.col("_lang")).otherwise(F.lit("und"))).withColumn("confidence", F.when(known, F.col("_sure")).otherwise(F.lit(0.0)))
    kept = [c for c in rows.columns if c not in ("text", "lang", "confidence", "accepted", "suffix", "text_lang")]
    return out.select(*kept, "suffix", "text_lang", F.col("_lang").alias("lang"), "confidence", ((F.col("_lang") != "und") & (F.col("confidence") >= CONFIDENCE)).alias("accepted"))


def visible_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    """The first part of the lang attribute of the html element."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def accepted_documents(docs: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows of ``docs`` whose language is told, with its columns. ``lang`` is their declaration, ``source`` their host.

    Rows of equal id and text stay or go together: they stay if one of them is accepted.
    """
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), text_hash().alias("text_hash"))
    found = identified(rows, trained(docs, languages), languages)
    gone = found.groupBy("doc_id", "text_hash").agg(F.max("accepted").alias("ok")).where("not ok").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(saved(gone, "gone"), F.col("doc_id").eqNullSafe(F.col("_id")) & text_hash().eqNullSafe(F.col("_hash")), "left_anti")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page. Trigrams are counted over all documents of a known language."""
    pages = table(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), url_host(F.col("url")).alias("host"))
    return identified(pages, trained(table(spark, sf_dir, "documents")))


QUERIES = {"op9_language": op9_language}
ORACLE: dict[str, str] = {}
