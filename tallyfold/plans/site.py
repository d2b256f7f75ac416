"""A source tree derived from web pages: components, the bundles of their folders, and seed names.

A page becomes a component in the folder ``host/language``; the form of its address decides which bundle
it opens and how, and its links become key calls. The keys of a folder's bundle are the links of its
``https`` pages and one key per page that nothing uses; ``#top`` pages share the bundle of their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import components as text
from tallyfold.operators import components as ops
from tallyfold.operators.reconcile import issues
from tallyfold.operators.summary import issue_counts, run_summary, translation_summary
from tallyfold.plans import bundle_sets, schema_catalog
from tallyfold.plans.tables import table
from tallyfold.session import written
from tallyfold.sources.corpus import corpus_from_table

PAGE_ATTRIBUTES = ("content", "class", "lang", "charset", "href")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = r"^https?://([^/]+)/([a-z]+)/"
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("url", place, 1).alias("host"),
        F.concat_ws("/", F.regexp_extract("url", place, 1), F.regexp_extract("url", place, 2)).alias("dir"),
        F.regexp_extract("url", place, 2).alias("lang"),
        text.captures(F.col("html"), r'<a href="/([^"]*)">').alias("links"),
    )


def _component() -> tuple[Column, Column]:
    """Path and content."""
    url, folder = F.col("url"), F.col("dir")
    ending = F.when(url.contains("?page="), ".test.tsx").when(url.endswith("/"), ".ts").otherwise(".tsx")
    path = F.concat_ws("/", folder, F.concat(F.col("page_id"), ending))

    def opened(at: Column, names: str = "{ t }") -> Column:
        return F.concat(F.lit(f"const {names} = useTranslation('"), at, F.lit("');\n"))

    head = (
        F.when(url.endswith("#top"), opened(F.col("host")))
        .when(url.endswith(".html"), F.concat(opened(folder), opened(folder)))
        .when(url.endswith("/"), F.concat(opened(folder, "{ t: tNav }"), opened(F.concat(F.lit("nowhere/"), F.col("lang")))))
        .otherwise(opened(folder))
    )
    body = F.regexp_replace("html", r'<a href="/([^"]*)">', "<a title=\"Go\">{t('$1')}")
    plain = url.contains("?utm_source=")
    return path, F.when(plain, F.col("html")).otherwise(F.concat(head, body))


def site_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(_pages(spark, sf_dir), *_component())


def site_bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(dir, valid, n_keys)`` and ``(dir, key)``."""
    secure = _pages(spark, sf_dir).where(F.col("url").startswith("https:"))
    own = F.array_append("links", F.concat(F.lit("unused_"), F.col("page_id")))
    # German bundles lack the source language, those of pill shops are malformed.
    own = F.when((F.col("lang") != "de") & ~F.col("host").contains("cheap-pills"), own)
    held = [
        secure.select("dir", own.alias("keys")),
        secure.where(F.col("url").endswith("#top")).select(F.col("host").alias("dir"), F.col("links").alias("keys")),
        secure.where(F.col("url").endswith("/")).select(F.concat("host", F.lit("/old")).alias("dir"), F.col("links").alias("keys")),
    ]
    every = held[0].unionByName(held[1]).unionByName(held[2])
    keys = every.select("dir", F.explode("keys").alias("key")).distinct()
    counted = keys.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    malformed = F.col("dir").contains("cheap-pills") & F.col("dir").contains("/") & ~F.col("dir").endswith("/old")
    bundles = every.select("dir").distinct().join(counted, "dir", "left")
    return bundles.select("dir", (~malformed).alias("valid"), F.coalesce("n", F.lit(0)).alias("n_keys")), keys


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ops.scanned_components(site_corpus(spark, sf_dir)), "scanned")[0]


def used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = site_corpus(spark, sf_dir)
    return corpus.select("path", F.explode(text.used_keys(F.col("content"))).alias("key"))


def hardcoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard-coded text of the pages themselves, and its place."""
    found = text.hardcoded_text(F.col("html"), PAGE_ATTRIBUTES)
    return table(spark, sf_dir, "pages").select("page_id", F.inline(found))


def component_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles, _ = site_bundles(spark, sf_dir)
    return ops.component_issues(_scanned(spark, sf_dir), bundles).select("type", "file", "text", "line", "count")


def component_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all issues of components, keys that their bundles lack included."""
    bundles, keys = site_bundles(spark, sf_dir)
    scanned = _scanned(spark, sf_dir)
    found = ops.component_issues(scanned, bundles).unionByName(ops.missing_keys(scanned, bundles, keys))
    return found.select("type", "file", "message")


def key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are used but not defined, and keys that are defined but not used."""
    bundles, keys = site_bundles(spark, sf_dir)
    scanned = _scanned(spark, sf_dir)
    missing = ops.missing_keys(scanned, bundles, keys)
    unused = ops.unused_keys(scanned, bundles, keys, ops.keys_used_below(site_corpus(spark, sf_dir))).select(
        F.lit("component_unused_key").alias("type"), F.col("dir").alias("place"), "key", "components"
    )
    return missing.select("type", F.col("file").alias("place"), "key", F.lit(None).cast("long").alias("components")).unionByName(unused)


def orphan_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles, _ = site_bundles(spark, sf_dir)
    return ops.orphan_bundles(_scanned(spark, sf_dir), bundles, site_corpus(spark, sf_dir).select("path", "dir"))


def _seed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, parts and suppliers; the global bundle knows the active ones, and the sources."""
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    seeds = {
        "customer": customer.select(F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")).alias("name")),
        "part": part.select(F.col("p_name").alias("name")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")),
        "timezones": None,
    }
    recent = table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 2001).select(F.col("o_custkey").alias("c_custkey"))
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    actual = (
        customer.join(recent, "c_custkey", "left_semi")
        .select(F.col("c_name").alias("key"))
        .unionByName(part.join(returned, "p_partkey", "left_semi").select(F.col("p_name").alias("key")))
        .unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("key")))
    )
    return ops.seed_name_issues(seeds, actual)


def global_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seed_names(spark, sf_dir).select("type", "key", "file")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by check and type, with the status of the check."""
    checks = {"catalog": schema_catalog.differences(spark, sf_dir), "bundles": bundle_sets.order_parity(spark, sf_dir)}
    counts = issue_counts(checks)
    totals = run_summary(counts, list(checks)).select("source", "status", "total_issues")
    return counts.join(totals, "source").select("source", "type", "issues", "status", "total_issues")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a whole translation check: files, components, orphans and the global bundle."""
    bundles, keys = site_bundles(spark, sf_dir)
    scanned, components_checked = written(ops.scanned_components(site_corpus(spark, sf_dir)), "scanned")
    bundles, folders_checked = written(bundles, "bundles")
    orphans = ops.orphan_bundles(scanned, bundles, site_corpus(spark, sf_dir).select("path", "dir"))
    components = (
        ops.component_issues(scanned, bundles)
        .unionByName(ops.missing_keys(scanned, bundles, keys))
        .unionByName(issues(orphans, "orphaned_translation_folder", file=F.col("dir")))
    )
    checked = {"components_checked": components_checked, "folders_checked": folders_checked}
    return translation_summary(bundle_sets.document_issues(spark, sf_dir), components, _seed_names(spark, sf_dir), **checked)


_SITE = r"""p AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
    regexp_extract(url, '^https?://([^/]+/[a-z]+)/', 1) AS dir, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS links,
    CASE WHEN url LIKE '%?page=%' THEN 'test' WHEN url LIKE '%/' THEN 'alias' WHEN url LIKE '%#top' THEN 'shared' WHEN url LIKE '%.html' THEN 'twice'
      WHEN url LIKE '%?utm_source=%' THEN 'plain' ELSE 'own' END AS form FROM pages),
  c AS (SELECT *, dir || '/' || page_id || CASE form WHEN 'test' THEN '.test.tsx' WHEN 'alias' THEN '.ts' ELSE '.tsx' END AS path,
    CASE form WHEN 'shared' THEN [host] WHEN 'twice' THEN [dir, dir] WHEN 'alias' THEN [dir, 'nowhere/' || lang] WHEN 'plain' THEN [] ELSE [dir] END AS calls FROM p),
  scanned AS (SELECT * FROM c WHERE form <> 'test'), using_ AS (SELECT * FROM scanned WHERE form <> 'plain'),
  used AS (SELECT DISTINCT path, dir, host, unnest(links) AS key FROM c WHERE form <> 'plain'),
  every AS (SELECT dir, CASE WHEN lang = 'de' OR host LIKE '%cheap-pills%' THEN [] ELSE list_append(links, 'unused_' || page_id) END AS keys,
      host LIKE '%cheap-pills%' AS bad FROM p WHERE url LIKE 'https:%'
    UNION ALL SELECT host, links, false FROM p WHERE url LIKE 'https:%' AND form = 'shared'
    UNION ALL SELECT host || '/old', links, false FROM p WHERE url LIKE 'https:%' AND form = 'alias'),
  keys AS (SELECT DISTINCT dir, unnest(keys) AS key FROM every),
  b AS (SELECT dir, NOT bool_or(bad) AS valid, (SELECT count(*) FROM keys k WHERE k.dir = every.dir) AS n_keys FROM every GROUP BY dir)"""

_CONTENT = r"""t AS (SELECT path AS place, CASE WHEN form = 'plain' THEN html ELSE CASE form
      WHEN 'shared' THEN 'const { t } = useTranslation(''' || host || ''');' || chr(10)
      WHEN 'twice' THEN repeat('const { t } = useTranslation(''' || dir || ''');' || chr(10), 2)
      WHEN 'alias' THEN 'const { t: tNav } = useTranslation(''' || dir || ''');' || chr(10) || 'const { t } = useTranslation(''nowhere/' || lang || ''');' || chr(10)
      ELSE 'const { t } = useTranslation(''' || dir || ''');' || chr(10) END
      || regexp_replace(html, '<a href="/([^"]*)">', '<a title="Go">{t(''\1'')}', 'g') END AS content FROM scanned)"""


def _found_sql(attributes: tuple[str, ...]) -> str:
    """Finds in ``t`` (place, content), with the line counted from the text before each match."""
    names = "|".join(attributes)
    patterns = [
        (">([^<]+)</", 1, "'jsx_text_node'", True),
        (f"({names})=[\"'']([^\"'']{{3,}})[\"'']", 2, f"'attribute_' || regexp_extract(m, '({names})=', 1)", False),
        ("<(button|a)[^>]*>([^<]+)</(button|a)>", 2, "regexp_extract(m, '<(button|a)', 1) || '_text'", True),
    ]
    parts = []
    for pattern, group, kind, sentence in patterns:
        rules = "f NOT LIKE '%{%' AND f NOT LIKE '%}%' AND NOT (length(f) > 5 AND regexp_matches(f, '\\p{Lu}') AND NOT regexp_matches(f, '[\\p{Ll}\\p{Lt}]'))"
        rules += " AND regexp_matches(f, '^\\p{Lu}') AND length(f) >= 3" if sentence else " AND f NOT LIKE '$%' AND f NOT LIKE '@%' AND f NOT LIKE '%()%'"
        parts.append(
            f"SELECT place, {kind} AS kind, f AS text, CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS INTEGER) AS line, "
            "trim(string_split(content, chr(10))[length(pre) - length(replace(pre, chr(10), '')) + 1], ' \t\n\r') AS context "
            f"FROM (SELECT *, trim(regexp_extract(m, '{pattern}', {group}), ' \t\n\r') AS f FROM (SELECT place, content, ms[i] AS m, array_to_string(segs[1:i], '') AS pre "
            f"FROM (SELECT *, regexp_extract_all(content, '{pattern}') AS ms, string_split(regexp_replace(content, '({pattern})', chr(1) || '\\1', 'g'), chr(1)) AS segs FROM t), "
            f"LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i))) WHERE {rules}"
        )
    return " UNION ALL ".join(parts)


_COMPONENTS_SQL = f"""WITH {_SITE}, {_CONTENT}, found AS ({_found_sql(("placeholder", "title", "label", "aria-label"))})
  SELECT 'translation_path_mismatch' AS type, path AS file, x AS text, NULL::INTEGER AS line, NULL::BIGINT AS count FROM (SELECT path, dir, unnest(calls) AS x FROM using_)
    WHERE x <> dir AND x NOT IN (SELECT dir FROM b)
  UNION ALL SELECT 'duplicate_use_translation', path, dir, NULL, 2 FROM using_ WHERE form = 'twice'
  UNION ALL SELECT 'aliased_translation_function', path, 'tNav', NULL, NULL FROM using_ WHERE form = 'alias'
  UNION ALL SELECT 'component_missing_translations', path, NULL, NULL, NULL FROM using_
    WHERE dir NOT IN (SELECT dir FROM b) AND NOT (form = 'shared' AND host IN (SELECT dir FROM b))
  UNION ALL SELECT 'component_hardcoded_text', place, found.text, found.line, NULL FROM found JOIN using_ ON place = path
  UNION ALL SELECT 'component_needs_translations', place, NULL, NULL, count(*) FROM found JOIN scanned ON place = path WHERE form = 'plain' GROUP BY place"""

_MISSING_SQL = """SELECT 'component_missing_key' AS type, path AS place, key, NULL::BIGINT AS components FROM (
    SELECT u.path, u.key, CASE WHEN o.valid THEN o.dir WHEN s.valid THEN s.dir END AS bundle FROM used u JOIN using_ c ON c.path = u.path
    LEFT JOIN b o ON o.dir = u.dir LEFT JOIN b s ON s.dir = c.calls[1]) AS r
  WHERE bundle IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.dir = r.bundle AND k.key = r.key)"""
_UNUSED_SQL = """SELECT 'component_unused_key', keys.dir, keys.key, count(*) FILTER (WHERE NOT list_contains(owner.links, keys.key))
  FROM keys JOIN b ON b.dir = keys.dir JOIN using_ AS owner ON owner.dir = keys.dir
  WHERE valid AND NOT EXISTS (SELECT 1 FROM used u WHERE u.path LIKE '%.tsx' AND u.key = keys.key AND (u.dir = keys.dir OR u.host = keys.dir))
  GROUP BY keys.dir, keys.key HAVING count(*) FILTER (WHERE NOT list_contains(owner.links, keys.key)) > 0"""
_ORPHANS_SQL = """SELECT dir, n_keys, min(c.path) AS component FROM b LEFT JOIN (SELECT * FROM c WHERE form <> 'test' AND path LIKE '%.tsx') AS c USING (dir)
  WHERE valid AND n_keys > 0 AND dir NOT IN (SELECT dir FROM using_ UNION SELECT unnest(calls) FROM using_) GROUP BY dir, n_keys"""
_GLOBAL_SQL = """WITH expected AS (SELECT c_name AS key FROM customer UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier),
  actual AS (SELECT c_name AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2001)
    UNION SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION SELECT source FROM documents)
  SELECT 'global_translations_missing_key' AS type, key, NULL::VARCHAR AS file FROM (FROM expected EXCEPT FROM actual)
  UNION ALL SELECT 'global_translations_extra_key', key, NULL FROM (FROM actual EXCEPT FROM expected)
  UNION ALL SELECT 'global_translations_seed_not_found', NULL, 'timezones'"""

QUERIES = {
    "used_keys": used_keys,
    "hardcoded_text": hardcoded_text,
    "component_issues": component_issues,
    "component_messages": component_messages,
    "key_usage": key_usage,
    "orphan_bundles": orphan_bundles,
    "global_keys": global_keys,
    "run_summary": summary,
    "translation_summary": translations,
}

ORACLE = {
    "used_keys": f"WITH {_SITE} SELECT path, key FROM used",
    "hardcoded_text": f"WITH t AS (SELECT page_id AS place, html AS content FROM pages) SELECT place AS page_id, kind, text, line, context FROM ({_found_sql(PAGE_ATTRIBUTES)})",
    "component_issues": _COMPONENTS_SQL,
    "component_messages": f"""WITH i AS ({_COMPONENTS_SQL}), d AS (SELECT *, regexp_replace(file, '/[^/]*$', '') AS dir FROM i)
        SELECT type, file, CASE type WHEN 'translation_path_mismatch' THEN 'The bundle of ' || text || ' is opened from ' || dir || ', and there is no such bundle'
          WHEN 'duplicate_use_translation' THEN '''' || text || ''' is opened ' || count || ' times in the same component'
          WHEN 'aliased_translation_function' THEN 'The lookup function goes by the name ' || text || ' here'
          WHEN 'component_missing_translations' THEN 'Texts are looked up, yet ' || dir || ' has no bundle and no other one is opened'
          WHEN 'component_hardcoded_text' THEN 'Line ' || line || ' shows a fixed text: ' || text ELSE 'No text is looked up, ' || count || ' are fixed' END AS message FROM d
        UNION ALL SELECT type, place, 'The bundle has no text for ' || key FROM (WITH {_SITE} {_MISSING_SQL})""",
    "key_usage": f"WITH {_SITE} {_MISSING_SQL} UNION ALL {_UNUSED_SQL}",
    "orphan_bundles": f"WITH {_SITE} {_ORPHANS_SQL}",
    "global_keys": _GLOBAL_SQL,
    "run_summary": f"""WITH i AS (SELECT 'catalog' AS source, type FROM ({schema_catalog.ORACLE["catalog_reconcile"]})
        UNION ALL SELECT 'bundles', type FROM ({bundle_sets.ORACLE["key_parity"]}))
        SELECT source, type, count(*) AS issues, 'validation_errors' AS status, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS total_issues
        FROM i GROUP BY source, type""",
    "translation_summary": f"""WITH n AS (SELECT (SELECT count(*) FROM ({bundle_sets.ORACLE["bundle_file_issues"]})) AS f,
          (SELECT count(*) FROM ({_COMPONENTS_SQL})) + (SELECT count(*) FROM (WITH {_SITE} {_MISSING_SQL})) + (SELECT count(*) FROM (WITH {_SITE} {_ORPHANS_SQL})) AS c,
          (SELECT count(*) FROM ({_GLOBAL_SQL})) AS g, (SELECT count(*) FROM (WITH {_SITE} SELECT * FROM scanned)) AS components_checked,
          (SELECT count(*) FROM (WITH {_SITE} SELECT * FROM b)) AS folders_checked)
        SELECT 'validation_errors' AS status, false AS valid, 'translations: ' || (f + c + g) || ' issues in ' || components_checked || ' components, ' || folders_checked || ' folders' AS message,
          f + c + g AS total_issues, components_checked, folders_checked, c AS component_issues, f AS file_issues FROM n""",
}
