"""Bundles derived from the test tables.

Orders: the bundle of a customer, with a language per status and a key per priority. Documents: a JSON
file per document, whose lines are the values; language and source decide what is wrong with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.bundles import (
    LANGUAGES,
    bundle_issues,
    bundle_lines,
    gap_fill,
    gap_plan,
    generation_summary,
    incomplete_files,
    key_parity,
    removal_counts,
    without_keys,
)
from tallyfold.plans.tables import table
from tallyfold.sources.bundles import bundle_entries, bundle_languages, parse_bundles

STATUSES = ("F", "O", "P")
CODES = {"O": "O-CN"}
DROPPED = ["1-URGENT", "5-LOW", "6-NONE"]


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, lang, key, value, last_order)``."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus", "o_orderpriority")
    last = orders.agg(F.max("o_orderkey").alias("last_order"))
    return last.select(
        F.concat(F.lit("b"), F.col("o_custkey")).alias("file"),
        F.col("o_orderstatus").alias("lang"),
        F.col("o_orderpriority").alias("key"),
        F.concat(F.lit('é "'), F.col("last_order"), F.lit('"')).alias("value"),
        "last_order",
    )


def order_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = order_entries(spark, sf_dir)
    return key_parity(entries, entries.select("file", "lang").distinct(), STATUSES)


def _order_plan(entries: DataFrame) -> DataFrame:
    return gap_plan(entries, STATUSES[0], STATUSES[1:])


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_plan(order_entries(spark, sf_dir))


def gap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incomplete_files(order_gaps(spark, sf_dir))


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation_summary(order_entries(spark, sf_dir), every=True, source=STATUSES[0], targets=STATUSES[1:])


def order_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory knows the values of orders with a returned line item."""
    entries = order_entries(spark, sf_dir)
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("last_order"))
    known = entries.where(F.col("lang") == STATUSES[0]).join(returned.distinct(), "last_order", "left_semi")
    memory = known.select(F.explode(F.array(F.lit("O-CN"), F.lit("P"))).alias("lang"), F.col("value").alias("source_text"))
    memory = memory.withColumn("target_text", F.concat_ws(":", "lang", "source_text"))
    return gap_fill(entries, _order_plan(entries), memory, CODES)


def order_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_counts(order_entries(spark, sf_dir), DROPPED)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_lines(without_keys(order_entries(spark, sf_dir), DROPPED))


def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``."""

    def lines(keep=None, *extra: Column) -> Column:
        numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(F.concat(F.lit("l"), i).alias("key"), line.alias("value")))
        kept = numbered if keep is None else F.filter(numbered, lambda e: keep(e["value"]))
        more = F.array(*extra) if extra else F.slice(numbered, 1, 0)
        return F.to_json(F.map_from_entries(F.concat(kept, more)))

    tag = F.struct(F.lit("doc").alias("key"), F.col("source").alias("value"))
    complete = F.format_string(
        '{"en": %s, "fr": %s, "de": %s, "xx": {"": 0}}', lines(), lines(lambda value: F.length(value) >= 60), lines(None, tag)
    )
    content = (
        F.when(F.col("lang") == "en", complete)
        .when(F.col("lang") == "fr", F.substr(complete, F.lit(1), F.length(complete) - 1))
        .when(F.col("lang") == "de", F.format_string('{"en": %s, "fr": ["x"], "de": null, "es": {"l0": "a", "l0": 2, "": "x", "e": ""}}', lines()))
        .when(F.col("source") < "src14", F.when(F.col("source") == "src0", "{}").when(F.col("source") == "src1", "null").otherwise("[1]"))
        .otherwise(F.format_string('{"es": %s}', lines()))
    )
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id", F.lit("translations.json")).alias("file"), content.alias("content"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_entries(bundle_languages(parse_bundles(document_bundles(spark, sf_dir))))


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_issues(parse_bundles(document_bundles(spark, sf_dir)))


def bundle_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_issues(spark, sf_dir).select("type", "file", "language", "key")


_ORDERS = """o AS MATERIALIZED (SELECT 'b' || o_custkey AS file, o_orderstatus AS lang, o_orderpriority AS key, max(o_orderkey) AS last_order,
    'é "' || max(o_orderkey) || '"' AS value FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority)"""
_GAPS = f"""{_ORDERS}, src AS MATERIALIZED (SELECT file, key, value FROM o WHERE lang = 'F'), t AS (SELECT * FROM (VALUES ('O'), ('P')) AS v(lang)),
  wanted AS MATERIALIZED (SELECT file, lang, key, value FROM src, t),
  plan AS MATERIALIZED (SELECT w.file, w.lang, w.key, 'add' AS action, w.value AS source_value FROM wanted AS w ANTI JOIN o ON o.file = w.file AND o.lang = w.lang AND o.key = w.key
    UNION ALL SELECT file, lang, key, 'remove', NULL FROM o WHERE lang <> 'F' AND file IN (SELECT file FROM src)
      AND NOT EXISTS (SELECT 1 FROM src WHERE src.file = o.file AND src.key = o.key))"""

_DOCS = """d AS (SELECT source || '/' || doc_id || '/translations.json' AS file, * FROM documents),
  l AS (SELECT file, lang AS doc_lang, source, 'l' || (i - 1) AS key, parts[i] AS value FROM (SELECT *, string_split(text, chr(10)) AS parts FROM d),
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
  e AS (
    SELECT file, 'en' AS lang, key, value, 'STRING' AS value_type FROM l WHERE doc_lang IN ('en', 'de')
    UNION ALL SELECT file, 'fr', key, value, 'STRING' FROM l WHERE doc_lang = 'en' AND length(value) >= 60
    UNION ALL SELECT file, 'de', key, value, 'STRING' FROM l WHERE doc_lang = 'en'
    UNION ALL SELECT file, 'de', 'doc', source, 'STRING' FROM d WHERE lang = 'en'
    UNION ALL SELECT file, 'xx', '', '0', 'BIGINT' FROM d WHERE lang = 'en'
    UNION ALL SELECT file, 'es', k, v, y FROM d, LATERAL (VALUES ('l0', '2', 'BIGINT'), ('', 'x', 'STRING'), ('e', '', 'STRING')) AS x(k, v, y) WHERE lang = 'de'
    UNION ALL SELECT file, 'es', key, value, 'STRING' FROM l WHERE doc_lang = 'es' AND source >= 'src14')"""
_SUPPORTED = ", ".join(f"('{lang}')" for lang in LANGUAGES)
_ISSUES = f"""WITH {_DOCS},
  langs AS (SELECT * FROM (VALUES {_SUPPORTED}) AS v(lang)),
  held AS (SELECT file, x AS lang FROM d, LATERAL (SELECT unnest(CASE WHEN lang = 'en' THEN ['en', 'fr', 'de'] WHEN lang = 'de' THEN ['en', 'es']
      WHEN lang = 'es' AND source >= 'src14' THEN ['es'] ELSE [] END) AS x)),
  ref AS (SELECT file, CASE WHEN lang = 'es' THEN 'es' ELSE 'en' END AS lang FROM d WHERE lang IN ('en', 'de') OR (lang = 'es' AND source >= 'src14')),
  rk AS (SELECT file, e.key FROM e JOIN ref USING (file, lang))
  SELECT 'json_parse_error' AS type, file, NULL AS language, NULL AS key FROM d WHERE lang = 'fr'
  UNION ALL SELECT 'invalid_format', file, NULL, NULL FROM d WHERE lang NOT IN ('en', 'fr', 'de') AND source < 'src14' AND source <> 'src0'
  UNION ALL SELECT 'invalid_format', file, 'fr', NULL FROM d WHERE lang = 'de'
  UNION ALL SELECT 'missing_language', file, langs.lang, NULL FROM (SELECT DISTINCT file FROM held) AS f, langs
    WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.file = f.file AND held.lang = langs.lang)
      AND NOT (langs.lang = 'fr' AND f.file IN (SELECT file FROM d WHERE lang = 'de'))
  UNION ALL SELECT 'invalid_key', file, lang, key FROM e WHERE key = '' AND lang <> 'xx'
  UNION ALL SELECT 'invalid_value', file, lang, key FROM e WHERE lang <> 'xx' AND (value = '' OR value_type <> 'STRING')
  UNION ALL SELECT 'missing_key', rk.file, held.lang, rk.key FROM rk JOIN held USING (file)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = rk.file AND e.lang = held.lang AND e.key = rk.key)
  UNION ALL SELECT 'extra_key', file, lang, key FROM e WHERE lang <> 'xx'
    AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.file = e.file AND rk.key = e.key)"""

_LINES = f"""WITH {_ORDERS}, k AS (SELECT *, max(key) OVER (PARTITION BY file, lang) AS last_key, max(lang) OVER (PARTITION BY file) AS last_lang
    FROM o WHERE key NOT IN ('1-URGENT', '5-LOW'))
  SELECT file, lang, 1 AS part, key, '    "' || key || '": "' || replace(value, '"', '\\"') || CASE WHEN key = last_key THEN '"' ELSE '",' END AS text FROM k
  UNION ALL SELECT DISTINCT file, lang, 0, '', '  "' || lang || '": {{' FROM k
  UNION ALL SELECT DISTINCT file, lang, 2, '', CASE WHEN lang = last_lang THEN '  }}' ELSE '  }},' END FROM k
  UNION ALL SELECT DISTINCT file, '', -1, '', '{{' FROM k
  UNION ALL SELECT DISTINCT file, chr(1114111), 3, '', '}}' FROM k"""

QUERIES = {
    "bundle_scan": document_entries,
    "bundle_file_issues": bundle_file_issues,
    "key_parity": order_parity,
    "gap_plan": order_gaps,
    "gap_files": gap_files,
    "gap_summary": gap_summary,
    "gap_fill": order_fill,
    "bundle_remove_keys": order_removal,
    "bundle_write": order_lines,
}

ORACLE = {
    "bundle_scan": f"WITH {_DOCS} SELECT * FROM e",
    "bundle_file_issues": _ISSUES,
    "key_parity": f"""WITH {_ORDERS}, ref AS (SELECT file, min(lang) AS reference FROM o GROUP BY file),
        rk AS (SELECT o.file, key, reference FROM o JOIN ref ON o.file = ref.file AND lang = reference),
        present AS (SELECT DISTINCT file, lang FROM o)
        SELECT rk.file, p.lang AS language, rk.key, 'missing_key' AS type, reference FROM rk JOIN present AS p ON p.file = rk.file
          WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file = rk.file AND o.lang = p.lang AND o.key = rk.key)
        UNION ALL SELECT o.file, lang, key, 'extra_key', reference FROM o JOIN ref ON o.file = ref.file
          WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.file = o.file AND rk.key = o.key)""",
    "gap_plan": f"WITH {_GAPS} SELECT * FROM plan",
    "gap_files": f"""WITH {_GAPS} SELECT file, count(DISTINCT lang) AS languages, count(*) FILTER (WHERE action = 'add') AS added,
        count(*) FILTER (WHERE action = 'remove') AS removed FROM plan GROUP BY file""",
    "gap_summary": f"""WITH {_GAPS}, f AS (SELECT count(DISTINCT file) AS m, count(DISTINCT (file, lang)) AS n FROM plan)
        SELECT 'success' AS status, n || ' languages had gaps in a run over ' || m || ' files' AS message, m AS folders_processed, n AS files_generated FROM f""",
    "gap_fill": f"""WITH {_GAPS}, r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        SELECT file, lang, key, value, 'kept' AS origin FROM o
          ANTI JOIN plan ON plan.file = o.file AND plan.lang = o.lang AND plan.key = o.key
        UNION ALL SELECT plan.file, plan.lang, plan.key, CASE WHEN l_orderkey IS NOT NULL THEN replace(plan.lang, 'O', 'O-CN') || ':' || source_value END,
          CASE WHEN l_orderkey IS NOT NULL THEN 'filled' ELSE 'pending' END
          FROM plan JOIN o ON o.file = plan.file AND o.lang = 'F' AND o.key = plan.key LEFT JOIN r ON l_orderkey = last_order WHERE action = 'add'""",
    "bundle_remove_keys": f"""WITH {_ORDERS} SELECT file, count(*) FILTER (WHERE key IN ('1-URGENT', '5-LOW')) AS removed,
        count(*) FILTER (WHERE key NOT IN ('1-URGENT', '5-LOW')) AS remaining FROM o GROUP BY file HAVING removed > 0""",
    "bundle_write": _LINES.replace("{{", "{").replace("}}", "}"),
}
