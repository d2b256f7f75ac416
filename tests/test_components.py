"""Components against bundles: one small tree per issue."""

from __future__ import annotations

import pytest

from tallyfold.operators import components as ops
from tallyfold.operators.summary import issue_counts, run_summary, translation_summary
from tallyfold.schemas import CORPUS

OPEN = "const { t } = useTranslation('%s');\n"


def checked(spark, files, bundles):
    """All component issues as (type, file, detail)."""
    corpus = spark.createDataFrame([(p, p.rpartition("/")[0] or ".", p.rpartition("/")[2], c) for p, c in files.items()], CORPUS)
    held = spark.createDataFrame([(d, k is not None, len(k or ())) for d, k in bundles.items()], "dir string, valid boolean, n_keys long")
    keys = spark.createDataFrame([(d, k) for d, ks in bundles.items() for k in ks or ()], "dir string, key string")
    scanned = ops.scanned_components(corpus)
    below = ops.keys_used_below(corpus)
    found = (
        ops.component_issues(scanned, held)
        .unionByName(ops.missing_keys(scanned, held, keys))
        .unionByName(ops.unused_key_issues(scanned, held, keys, below))
    )
    got = {(r["type"], r["file"], r["text"] or r["key"] or r["count"]) for r in found.collect()}
    orphans = ops.orphan_bundles(scanned, held, corpus.select("path", "dir"))
    return got | {("orphan", r["dir"], r["component"]) for r in orphans.collect()}


CASES = {
    "clean": ({"a/X/X.tsx": OPEN % "a/X" + "t('hello')"}, {"a/X": ["hello"]}, set()),
    "bundle missing": (
        {"a/X/X.tsx": OPEN % "a/X" + "t('hello')"},
        {},
        {("component_missing_translations", "a/X/X.tsx", None)},
    ),
    "plain text": (
        {"a/X/X.tsx": '<label>Some text</label><button>Press it</button><i placeholder="Your name"/>'},
        {},
        {("component_needs_translations", "a/X/X.tsx", 4)},
    ),
    "text beside keys": (
        {"a/X/X.tsx": OPEN % "a/X" + "t('k') <p>Some text</p>"},
        {"a/X": ["k"]},
        {("component_hardcoded_text", "a/X/X.tsx", "Some text")},
    ),
    "wrong path": (
        {"a/X/X.tsx": OPEN % "wrong" + "t('k')"},
        {"a/X": ["k"]},
        {("translation_path_mismatch", "a/X/X.tsx", "wrong")},
    ),
    "shared parent": ({"a/X/X.tsx": OPEN % "a" + "t('k')", "a/A.tsx": OPEN % "a"}, {"a": ["k"]}, set()),
    "undefined key": (
        {"a/X/X.tsx": OPEN % "a/X" + "t('k') t('lost')"},
        {"a/X": ["k"]},
        {("component_missing_key", "a/X/X.tsx", "lost")},
    ),
    "unused key": (
        {"a/X/X.tsx": OPEN % "a/X" + "t('k')", "a/X/sub/Y.tsx": "t('deep')", "a/X/X.test.tsx": "t('tested')", "a/Z.tsx": "t('k')"},
        {"a/X": ["k", "deep", "tested", "free"], "a": ["k"]},
        {
            ("component_unused_key", "a/X/X.tsx", "free"),
            ("component_missing_translations", "a/X/sub/Y.tsx", None),
        },
    ),
    "opened twice": (
        {"a/X/X.tsx": OPEN % "a/X" * 2 + "t('k')"},
        {"a/X": ["k"]},
        {("duplicate_use_translation", "a/X/X.tsx", "a/X")},
    ),
    "alias": (
        {"a/X/X.tsx": "const { t: tTest } = useTranslation('a/X'); tTest('k')"},
        {"a/X": ["k"]},
        {("aliased_translation_function", "a/X/X.tsx", "tTest")},
    ),
    "unreadable own bundle": (
        {"a/X/X.tsx": OPEN % "a" + "t('k') t('lost')"},
        {"a/X": None, "a": ["k"]},
        {("component_missing_key", "a/X/X.tsx", "lost")},
    ),
    "no source language": (
        {"a/X/X.tsx": OPEN % "a/X" + "t('k')"},
        {"a/X": []},
        {("component_missing_key", "a/X/X.tsx", "k")},
    ),
    "orphans": (
        {"a/X/X.tsx": "x", "a/X/index.ts": "x", "b/other.tsx": "x", "b/o.test.tsx": "x"},
        {"a/X": ["k"], "b": ["k"], "c": ["k"], "d": [], "providers/TranslationProvider": ["k"], "e": None},
        {("orphan", "a/X", "a/X/X.tsx"), ("orphan", "b", "b/other.tsx"), ("orphan", "c", None)},
    ),
    "top folder": ({"X.tsx": OPEN % "." + "t('k')", "a/b/Y.tsx": OPEN % "." + "t('m')"}, {".": ["k", "m"]}, set()),
    "test file": ({"a/X/X.test.tsx": "<p>Some text</p> useTranslation('q')"}, {}, set()),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_component(spark, case):
    files, bundles, expected = CASES[case]
    assert checked(spark, files, bundles) == expected


def test_seed_names(spark, rows):
    def names(*n):
        return spark.createDataFrame([(x,) for x in n], "name string")

    def keys(*n):
        return spark.createDataFrame([(x,) for x in n], "key string")

    seeds = {"theme": names(" Dark ", "Light", ""), "languages": names("Dark"), "timezones": None}
    assert rows(ops.seed_name_issues(seeds, keys("Dark", "More")), "type", "key", "file") == [
        ("global_translations_extra_key", "More", None),
        ("global_translations_missing_key", "Light", None),
        ("global_translations_seed_not_found", None, "timezones"),
    ]
    assert rows(ops.seed_name_issues(seeds, None), "type") == [("global_translations_missing",), ("global_translations_seed_not_found",)]
    assert rows(ops.seed_name_issues({"theme": names("A")}, keys("A"))) == []


def test_summaries(spark, rows):
    def typed(*types):
        return spark.createDataFrame([(t,) for t in types], "type string")

    counts = issue_counts({"one": typed("a", "a", "b"), "two": typed()})
    assert rows(counts) == [("one", "a", 2), ("one", "b", 1)]
    assert rows(run_summary(counts, ["one", "two"])) == [("one", "validation_errors", False, 3, 2), ("two", "success", True, 0, 0)]
    got = translation_summary(typed("missing_key"), typed("component_missing_key", "orphaned_translation_folder"), typed("global_translations_missing_key"))
    assert rows(got, "status", "message", "total_issues", "component_issues", "file_issues") == [("validation_errors", "translations: 4 issues", 4, 2, 1)]
    clean = translation_summary(typed(), typed(), typed(), components_checked=3)
    assert rows(clean, "status", "valid", "message", "components_checked") == [("success", True, "translations: no issues in 3 components", 3)]
