"""Object inventories, manifests, file listings and CSV round trips over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.components import folder_of
from tallyfold.operators.mirror import (
    bucket_list,
    chosen_buckets,
    content_type,
    manifest,
    mirror_apply,
    mirror_counts,
    mirror_diff,
    mirror_run,
    mirror_totals,
)
from tallyfold.plans.tables import table
from tallyfold.session import scratch_path
from tallyfold.sinks.csv_files import write_csv
from tallyfold.sinks.lines import numbered_lines, read_lines, write_lines
from tallyfold.sinks.tables import read_rows, replace_rows
from tallyfold.sources.corpus import corpus_from_table, read_corpus
from tallyfold.sources.csv_files import load_strict
from tallyfold.sources.files import is_component, is_system_file, named
from tallyfold.sources.storage import list_tree

BUCKETS = ("click", "purchase", "signup", "view", "absent")
SPLIT_DAY = "2024-01-16"


def event_inventory(spark: SparkSession, sf_dir: str, recent: bool) -> DataFrame:
    """INVENTORY rows: an object per type, user and k; the last value gives its size.

    Events of the second half of the month are the remote side, those of the first half the local copy,
    in which k = 0 stands for a system file.
    """
    day = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    half = F.col("ts") >= day if recent else F.col("ts") < day
    k = F.get_json_object("props", "$.k")
    name = F.concat(k, F.lit(".json")) if recent else F.when(k == "0", ".objects").otherwise(F.concat(k, F.lit(".json")))
    return (
        table(spark, sf_dir, "events")
        .where(half)
        .groupBy(F.col("event_type").alias("bucket"), F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), name).alias("key"))
        .agg(F.floor(F.max_by("value", F.struct("ts", "event_id")) / 50).alias("size"))
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return event_inventory(spark, sf_dir, True), event_inventory(spark, sf_dir, False)


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror_diff(*_sides(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror_counts(mirror_diff(*_sides(spark, sf_dir), BUCKETS))


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets that exist: those of all events, and one without objects."""
    named = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"))
    return named.unionByName(spark.createDataFrame([("absent",)], "bucket string")).distinct()


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = _existing(spark, sf_dir)
    return mirror_totals(mirror_diff(*_sides(spark, sf_dir), BUCKETS, existing), chosen_buckets(existing, BUCKETS))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror_run(*_sides(spark, sf_dir), BUCKETS, _existing(spark, sf_dir))


def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror_apply(*_sides(spark, sf_dir), BUCKETS)


def _url_path() -> Column:
    return F.regexp_extract("url", r"^https?://([^?#]+)", 1)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder contents of the page addresses, and the list of buckets."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^\w+", 0).alias("bucket"), F.rtrim(_url_path(), F.lit("/")).alias("key"))
    listed = bucket_list(pages, table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket")))
    return (
        manifest(pages)
        .select(F.lit(".objects").alias("file"), "bucket", "dir", "child")
        .unionByName(listed.select(F.lit(".buckets").alias("file"), F.lit("").alias("bucket"), F.lit("").alias("dir"), F.col("bucket").alias("child")))
    )


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".tar.gz").when(F.col("lang") == "de", ".svgz").otherwise(".JPG")
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id"), ending)).alias("path"))
    paths = table(spark, sf_dir, "pages").select(_url_path().alias("path")).unionByName(docs)
    return paths.select("path", content_type(F.col("path")).alias("content_type"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, size)``: pages, documents and system turns as files of a source tree."""
    url = F.col("url")
    folder, number = F.regexp_extract("url", r"^https?://([^/]+/[a-z]+)/", 1), F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/(\d+)", 1)
    name = (
        F.when(url.endswith(".html"), F.concat(number, F.lit(".tsx")))
        .when(url.endswith("/"), F.concat(number, F.lit("/index.ts")))
        .when(url.contains("?page="), F.concat(number, F.lit(".test.tsx")))
        .when(url.endswith("#top"), F.concat(F.lit("utils/"), number, F.lit(".ts")))
        .when(url.contains("?utm_source="), F.concat(F.lit("providers/"), number, F.lit(".tsx")))
        .otherwise(F.concat(number, F.lit("/types.ts")))
    )
    pages = table(spark, sf_dir, "pages").select(F.concat_ws("/", folder, name).alias("path"), F.length("html").alias("size"))
    seed = F.when(F.col("source") == "src0", "meta/catalog/seed.csv").otherwise("meta/seed.csv")
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id", seed).alias("path"), F.length("text").alias("size"))
    last = F.when(F.col("role") == "system", ".DS_Store").otherwise("seed.txt")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn", last).alias("path"), F.length("text").alias("size"))
    return pages.unionByName(docs).unionByName(turns)


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(spark, sf_dir)
    parts = {
        "component": files.where(is_component(F.col("path"))),
        "seed": named(files, "seed.csv", without="meta/catalog/seed.csv"),
        "content": files.where(~is_system_file(F.col("path"))),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "path", "size") for kind, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus; French and German ones come with other line breaks."""
    lang = F.col("lang")
    content = F.when(lang == "fr", F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(lang == "de", F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    corpus = corpus_from_table(table(spark, sf_dir, "documents"), path, content)
    return corpus.select("path", "dir", "name", F.md5("content").alias("hash"), F.size(F.split("content", "\n", -1)).alias("lines"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which some languages are empty text and some sources NULL."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("source") != "src1", F.col("source")).alias("source"),
        "n_chars",
    )


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to CSV and back; returns what comes back."""
    path = scratch_path(spark, "snapshot")
    write_csv(_documents(spark, sf_dir), path)
    return load_strict(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


def csv_strict_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to CSV without the NULL rule of empty text, loaded strictly into a table."""
    path, target = scratch_path(spark, "export"), scratch_path(spark, "loaded")
    turns = table(spark, sf_dir, "conversations")
    turns = turns.withColumn("role", F.when(F.col("role") == "user", "").otherwise(F.col("role")))
    write_csv(turns, path, keep_empty=False)
    replace_rows(load_strict(spark, path, "conv_id long, turn long, role string, text string"), target)
    return read_rows(spark, target)


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files in a folder for each source: the bytes in each folder, and the hidden files that the writer left beside them."""
    path = scratch_path(spark, "tree")
    table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(path)
    files = list_tree(spark, [path, f"{path}/absent"])
    folder = F.regexp_extract("path", "/source=([^/]+)/[^/]+$", 1)
    marker = F.col("name") == "_SUCCESS"
    kept = files.where(marker | F.startswith("name", F.lit("part-"))).groupBy(folder.alias("folder"))
    return kept.agg(F.sum("size").alias("bytes"), F.count_if(marker).alias("markers"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files in a folder for each source and language, those in German broken: what is read of each folder, and what is not."""
    path = scratch_path(spark, "corpus")
    broken = F.concat(F.expr("cast(unhex('ff') as string)"), F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select("source", "lang", F.when(F.col("lang") == "de", broken).otherwise(F.col("text")).alias("text"))
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    texts, failed = read_corpus(spark, [path, f"{path}/absent"], path)
    read = texts.groupBy("dir").agg(F.sum(F.length("content").cast("long")).alias("chars")).select("dir", F.lit(None).cast("string").alias("reason"), "chars")
    lost = failed.where(F.col("path").endswith(".txt")).where(~F.substring_index("path", "/", -1).startswith("."))
    lost = lost.select(folder_of(F.col("path")).alias("dir"), "reason").distinct()
    return read.unionByName(lost.withColumn("chars", F.lit(None).cast("long")))


def numbered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses written in order, and read back with their line numbers."""
    path = scratch_path(spark, "urls")
    write_lines(table(spark, sf_dir, "pages").select(F.col("url").alias("text")), path, ["text"])
    return read_lines(spark, path)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every line item among all, by order and number."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return numbered_lines(items, items.columns).select("l_orderkey", "l_linenumber", "line")


_FILES_SQL = "strlen(coalesce(text, '')) + 1"

_EVENTS = """side AS (SELECT ts >= TIMESTAMP '2024-01-16' AS recent, event_type AS bucket, 'u' || user_id || '/' ||
    CASE WHEN ts < TIMESTAMP '2024-01-16' AND props = '{"k": 0}' THEN '.objects' ELSE regexp_extract(props, '[0-9]+') || '.json' END AS key,
    CAST(floor(arg_max(value, (ts, event_id)) / 50) AS BIGINT) AS size FROM events GROUP BY ALL),
  d AS (SELECT bucket, key, r.size AS remote_size, l.size AS local_size,
    CASE WHEN r.size = l.size THEN 'keep' WHEN r.size IS NOT NULL THEN 'download' WHEN key LIKE '%/.objects' THEN 'system' ELSE 'delete' END AS action
    FROM (FROM side WHERE recent) AS r FULL JOIN (FROM side WHERE NOT recent) AS l USING (bucket, key))"""
_SOME = "('click', 'purchase', 'signup', 'view')"
_PATH = "regexp_extract(url, '^https?://([^?#]+)', 1)"
_FOLDER, _NUMBER = "regexp_extract(url, '^https?://([^/]+/[a-z]+)/', 1)", "regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1)"
_FILES = f"""files AS (
  SELECT {_FOLDER} || '/' || CASE WHEN url LIKE '%.html' THEN {_NUMBER} || '.tsx' WHEN url LIKE '%/' THEN {_NUMBER} || '/index.ts'
      WHEN url LIKE '%?page=%' THEN {_NUMBER} || '.test.tsx' WHEN url LIKE '%#top' THEN 'utils/' || {_NUMBER} || '.ts'
      WHEN url LIKE '%?utm_source=%' THEN 'providers/' || {_NUMBER} || '.tsx' ELSE {_NUMBER} || '/types.ts' END AS path,
    CAST(length(html) AS INTEGER) AS size, url LIKE '%.html' OR url LIKE '%/' OR url LIKE '%?utm_source=%' AS component, false AS seed, true AS content FROM pages
  UNION ALL SELECT source || '/' || doc_id || CASE WHEN source = 'src0' THEN '/meta/catalog/seed.csv' ELSE '/meta/seed.csv' END,
    CAST(length(text) AS INTEGER), false, source <> 'src0', true FROM documents
  UNION ALL SELECT conv_id || '/' || turn || CASE WHEN role = 'system' THEN '/.DS_Store' ELSE '/seed.txt' END, CAST(length(text) AS INTEGER), false, false,
    role <> 'system' FROM conversations)"""

QUERIES = {
    "mirror_diff": diff,
    "mirror_counts": counts,
    "mirror_totals": totals,
    "mirror_run": run,
    "mirror_apply": apply,
    "manifest": manifests,
    "content_type": content_types,
    "file_inventory": file_inventory,
    "corpus_scan": corpus_scan,
    "snapshot_roundtrip": snapshot_roundtrip,
    "csv_strict_load": csv_strict_load,
    "tree_listing": tree_listing,
    "corpus_files": corpus_files,
    "numbered_urls": numbered_urls,
    "line_numbers": line_numbers,
}

ORACLE = {
    "mirror_diff": f"WITH {_EVENTS} SELECT * FROM d WHERE action <> 'system'",
    "mirror_counts": f"""WITH {_EVENTS} SELECT bucket, count(*) FILTER (WHERE action = 'download') AS downloaded,
        count(*) FILTER (WHERE action = 'delete') AS deleted FROM d WHERE bucket IN {_SOME} AND action <> 'system' GROUP BY bucket""",
    "mirror_totals": f"""WITH {_EVENTS}, v AS (SELECT * FROM d WHERE bucket IN {_SOME} AND action <> 'system'),
        c AS (SELECT b.bucket, count(*) FILTER (WHERE action = 'download') AS downloaded, count(*) FILTER (WHERE action = 'delete') AS deleted
          FROM (SELECT DISTINCT event_type AS bucket FROM events WHERE event_type IN {_SOME} UNION ALL SELECT 'absent') AS b LEFT JOIN v USING (bucket) GROUP BY b.bucket)
        SELECT bucket, downloaded, deleted FROM c UNION ALL SELECT NULL, sum(downloaded)::BIGINT, sum(deleted)::BIGINT FROM c""",
    "mirror_run": f"""WITH {_EVENTS}, v AS (SELECT * FROM d WHERE bucket IN {_SOME}),
        n AS (SELECT (SELECT count(DISTINCT event_type) + 1 FROM events WHERE event_type IN {_SOME}) AS buckets, count(*) FILTER (WHERE action = 'download') AS downloaded,
          count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'keep') AS kept FROM v)
        SELECT 'success' AS status, buckets || ' buckets mirrored: ' || downloaded || ' objects fetched, ' || deleted || ' removed' AS message, * FROM n""",
    "mirror_apply": f"""WITH {_EVENTS} SELECT bucket, key, size FROM side WHERE recent AND bucket IN {_SOME}
        UNION ALL SELECT bucket, key, size FROM side WHERE NOT recent AND (bucket NOT IN {_SOME} OR key LIKE '%/.objects')""",
    "manifest": f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+') AS bucket, string_split(rtrim({_PATH}, '/'), '/') AS parts FROM pages)
        SELECT DISTINCT '.objects' AS file, bucket, array_to_string(parts[1:i], '/') AS dir, parts[i + 1] AS child FROM p, LATERAL (SELECT unnest(range(0, len(parts))) AS i)
        UNION ALL SELECT DISTINCT '.buckets', '', '', regexp_extract(url, '^[a-z]+') FROM pages
        UNION ALL SELECT DISTINCT '.buckets', '', '', event_type FROM events""",
    "content_type": f"""SELECT {_PATH} AS path, CASE WHEN {_PATH} LIKE '%.html' THEN 'text/html' END AS content_type FROM pages
        UNION ALL SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.tar.gz' WHEN 'de' THEN '.svgz' ELSE '.JPG' END,
          CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'application/x-tar' WHEN 'de' THEN 'image/svg+xml' ELSE 'image/jpeg' END FROM documents""",
    "file_inventory": f"""WITH {_FILES} SELECT 'component' AS kind, path, size FROM files WHERE component UNION ALL SELECT 'seed', path, size FROM files WHERE seed
        UNION ALL SELECT 'content', path, size FROM files WHERE content""",
    "corpus_scan": """SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, doc_id || '.txt' AS name,
        md5(text) AS hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines FROM documents""",
    "snapshot_roundtrip": """SELECT doc_id, text, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS lang,
        CASE WHEN source <> 'src1' THEN source END AS source, n_chars FROM documents""",
    "csv_strict_load": "SELECT conv_id, turn, nullif(role, 'user') AS role, text FROM conversations",
    "tree_listing": f"""SELECT source AS folder, sum({_FILES_SQL})::BIGINT AS bytes, 0::BIGINT AS markers FROM documents GROUP BY source
        UNION ALL SELECT '', 0, 1""",
    "corpus_files": """SELECT 'source=' || source || '/lang=' || lang AS dir, CASE WHEN lang = 'de' THEN 'not valid UTF-8' END AS reason,
        CASE WHEN lang <> 'de' THEN sum(length(text) + 1)::BIGINT END AS chars FROM documents WHERE text IS NOT NULL GROUP BY source, lang""",
    "numbered_urls": "SELECT row_number() OVER (ORDER BY url) AS line, url AS text FROM pages",
    "line_numbers": """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line
        FROM lineitem""",
}
