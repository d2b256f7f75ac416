"""Bundles: one case per issue, gaps, merge, removal, JSON text."""

from __future__ import annotations

import json

import pytest
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
from tallyfold.sinks.lines import write_lines
from tallyfold.sources.bundles import bundle_entries, bundle_languages, parse_bundles

FULL = {lang: {"hello": "x"} for lang in LANGUAGES}
ISSUES = {
    "complete": (json.dumps(FULL), {}),
    "only_en": ('{"en": {"hello": "Hello"}}', {"missing_language": 23}),
    "truncated": ('{"en": {"hello": "Hello"}', {"json_parse_error": 1}),
    "list": ("[1]", {"invalid_format": 1}),
    "null": ("null", {"invalid_format": 1}),
    "empty": ("{}", {}),
    "parity": (json.dumps(FULL | {"en": {"hello": "a", "goodbye": "b"}, "es": {"hello": "a", "extra": "b"}}), {"missing_key": 23, "extra_key": 1}),
    "inner_list": (json.dumps(FULL | {"es": ["x"]}), {"invalid_format": 1}),
    "no_en": (json.dumps({k: v for k, v in FULL.items() if k != "en"}), {"missing_language": 1}),
    "values": (json.dumps({lang: {"": "a", "e": "", "n": 1, "o": {}} for lang in LANGUAGES}), {"invalid_key": 24, "invalid_value": 72}),
    "null_language": (json.dumps(FULL | {"fr": None}), {"missing_language": 1}),
    "empty_reference": (json.dumps(FULL | {"en": {}}), {"extra_key": 23}),
    "repeated": (json.dumps(FULL).replace('"en": {"hello": "x"}', '"en": {"hello": 1, "hello": "x"}'), {}),
    "other_language": (json.dumps(FULL | {"xx": {"": 1}}), {}),
}


@pytest.mark.parametrize("case", sorted(ISSUES))
def test_issues_of_a_file(spark, case):
    content, expected = ISSUES[case]
    parsed = parse_bundles(spark.createDataFrame([(case, content)], "file string, content string"))
    found = bundle_issues(parsed).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in found} == expected


def test_issue_fields(spark, rows):
    content = json.dumps(FULL | {"en": {"hello": "a", "goodbye": "b"}, "es": {"extra": "b"}})
    found = bundle_issues(parse_bundles(spark.createDataFrame([("f", content)], "file string, content string")))
    got = rows(found.where("language = 'es'"), "type", "key", "message")
    assert got == [
        ("extra_key", "extra", "'es' defines key 'extra', which 'en' lacks"),
        ("missing_key", "goodbye", "'es' lacks key 'goodbye', which 'en' defines"),
        ("missing_key", "hello", "'es' lacks key 'hello', which 'en' defines"),
    ]


def test_long_form_agrees_with_files(spark, rows):
    content = [(name, text) for name, (text, _) in ISSUES.items()]
    parsed = parse_bundles(spark.createDataFrame(content, "file string, content string"))
    languages = bundle_languages(parsed)
    by_key = key_parity(bundle_entries(languages), languages.where("kind = 'OBJECT'"))
    by_file = bundle_issues(parsed).where(F.col("type").isin("missing_key", "extra_key"))
    order = ("file", "language", "key", "type")
    assert rows(by_key, *order) == rows(by_file, *order)


def test_entries_keep_json_of_other_values(spark, rows):
    parsed = parse_bundles(spark.createDataFrame([("f", '{"en": {"a": 1, "b": "x", "c": null}}')], "file string, content string"))
    assert rows(bundle_entries(bundle_languages(parsed)), "key", "value", "value_type") == [
        ("a", "1", "BIGINT"),
        ("b", "x", "STRING"),
        ("c", "null", "VOID"),
    ]


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, lang string, key string, value string")


def test_gaps(spark, rows):
    e = entries(spark, ("f", "en", "hello", "H"), ("f", "en", "bye", "B"), ("g", "es", "x", "X"))
    assert rows(incomplete_files(gap_plan(e))) == [("f", 23, 46, 0)]
    full = entries(spark, *[("f", lang, "hello", "x") for lang in LANGUAGES])
    assert rows(gap_plan(full)) == []
    assert gap_plan(full, force=True).count() == 23


def test_generation_summary(spark, rows):
    e = entries(spark, ("f", "en", "hello", "H"), ("g", "en", "x", "X"), ("g", "es", "x", "X"))
    assert rows(generation_summary(e, every=True)) == [("success", "45 languages had gaps in a run over 2 files", 2, 45)]
    assert rows(generation_summary(e, "g", targets=("es",))) == [("success", "0 languages had gaps in a run over 1 files", 1, 0)]
    assert [r[0] for r in rows(generation_summary(e), "status")] == ["error"]
    assert [r[0] for r in rows(generation_summary(e, "f", every=True), "status")] == ["error"]


def test_fill(spark, rows):
    e = entries(
        spark, ("f", "en", "a", "A"), ("f", "en", "b", "B"), ("f", "zh", "a", "old"), ("f", "zh", "extra", "E"), ("f", "xx", "q", "Q")
    )
    memory = spark.createDataFrame([("zh-CN", "B", "b-zh"), ("es", "A", "a-es")], "lang string, source_text string, target_text string")
    filled = gap_fill(e, gap_plan(e, targets=("zh", "es")), memory)
    assert rows(filled, "lang", "key", "value", "origin") == [
        ("en", "a", "A", "kept"),
        ("en", "b", "B", "kept"),
        ("es", "a", "a-es", "filled"),
        ("es", "b", None, "pending"),
        ("xx", "q", "Q", "kept"),
        ("zh", "a", "old", "kept"),
        ("zh", "b", "b-zh", "filled"),
    ]
    # A complete bundle has no gaps left.
    done = filled.where("value IS NOT NULL")
    again = gap_plan(done, targets=("zh",))
    assert rows(again) == []


def test_removal(spark, rows):
    e = entries(spark, *[("f", lang, key, "x") for lang in ("en", "es", "fr") for key in ("hello", "goodbye", "thanks")])
    assert rows(removal_counts(e, ["goodbye"])) == [("f", 3, 6)]
    assert rows(removal_counts(e, ["goodbye", "thanks"])) == [("f", 6, 3)]
    assert rows(removal_counts(e, ["other"])) == []
    assert without_keys(e, ["goodbye"]).count() == 6


def test_json_text(spark, tmp_path):
    data = {"en": {"b": 'say "x"\n\\', "a": "ü"}, "de": {"": "日本", "z": "/"}}
    e = entries(spark, *[("f", lang, k, v) for lang, kv in data.items() for k, v in kv.items()])
    write_lines(bundle_lines(e), str(tmp_path / "out"), ["file", "lang", "part", "key"], ["file"])
    parts = sorted((tmp_path / "out" / "file=f").glob("part-*"))
    expected = json.dumps({k: dict(sorted(v.items())) for k, v in sorted(data.items())}, ensure_ascii=False, indent=2)
    assert "".join(p.read_text(encoding="utf-8") for p in parts) == expected + "\n"
