"""Column expressions against Python's own string methods and regular expressions."""

from __future__ import annotations

import mimetypes
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyfold.functions import components, ddl, identifiers, text, tokens, types
from tallyfold.operators.mirror import content_type

TRICKY = [
    "", " ", "a", "A", "É", "éa", "ABC", "ABCDEF", "ABC 1", "aB", "ǅ", "ǅABC", "123", "\x1f x ", "　a\x85",
    "Straße", "ª", "Ⅷ", "x\r\ny\rz", "_", "__", "a_b", "1a", "²a", '"q"', '"', "a b", "a-b", "Ünï", "日本", "a.b.c", "٣x",
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_and_case(spark):
    assert column(spark, TRICKY, text.strip) == [v.strip() for v in TRICKY]
    assert column(spark, TRICKY, text.is_upper) == [v.isupper() for v in TRICKY]
    assert column(spark, TRICKY, text.starts_upper) == [v[:1].isupper() for v in TRICKY]
    assert column(spark, TRICKY, text.unix_newlines) == [v.replace("\r\n", "\n").replace("\r", "\n") for v in TRICKY]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=40, max_size=60))
def test_strip_of_any_text(spark, values):
    values = [v for v in values if not re.search(r"[\ud800-\udfff]", v)]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_quoting(spark):
    def quoted(v):
        if v.startswith('"') and v.endswith('"'):
            return v
        plain = v.replace("_", "").isalnum() and not v[0].isdigit() and not any(c.isupper() for c in v)
        return v if plain else f'"{v}"'

    names = [v for v in TRICKY if v]
    assert column(spark, names, identifiers.quote_identifier) == [quoted(v) for v in names]
    assert column(spark, ["meta.a b", "A.b.c", "plain"], identifiers.quote_qualified) == ['meta."a b"', '"A"."b.c"', "plain"]


def test_diagram_names(spark):
    expected = ["".join(c for c in v.replace(" ", "_") if c.isalnum() or c == "_") for v in TRICKY]
    assert column(spark, TRICKY, identifiers.diagram_name) == expected


def test_table_path(spark):
    assert column(spark, ["meta.a__b__c", "u.x"], identifiers.table_path) == ["meta/a/b/c/create.sql", "u/x/create.sql"]
    with pytest.raises(PySparkException):
        column(spark, ["nodot"], identifiers.table_path)


def test_tokens(spark):
    words = ["TRUE", " true ", "False", "t", "yes", "1", "", "NULL"]
    assert column(spark, words, tokens.bool_token) == [True, True, False, None, None, None, None, None]
    assert column(spark, ["null", " x ", "", " NULL "], tokens.null_token) == [None, "x", None, None]
    assert column(spark, ["0", " NULL", "", "7"], tokens.is_table_row) == [True, True, True, False]
    with pytest.raises(PySparkException):
        column(spark, ["seven"], tokens.order_number)


def test_types(spark):
    df = spark.createDataFrame(
        [
            ("integer", "nextval('s')", None, 32, 0),
            ("integer", None, None, 32, 0),
            ("character varying", None, 50, None, None),
            ("character varying", None, None, None, None),
            ("character", None, 10, None, None),
            ("numeric", None, None, 10, 2),
            ("numeric", None, None, 10, 0),
            ("numeric", None, None, None, None),
        ],
        "t string, d string, l int, p int, s int",
    )
    got = df.select(types.ddl_type(*[F.col(c) for c in "tdlps"]), types.compare_type(F.col("t"), F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["SERIAL", "INTEGER", "VARCHAR(50)", "TEXT", "TEXT", "NUMERIC(10,2)", "NUMERIC(10)", "NUMERIC"]
    assert [r[1] for r in got][5:] == ["NUMERIC(10,2)", "NUMERIC", "NUMERIC"]
    diagram = column(spark, ["NUMERIC(10,2)", "TIMESTAMP WITH TIME ZONE", "TEXT", None], types.diagram_type)
    assert diagram == ["DECIMAL", "TIMESTAMP", "TEXT", "TEXT"]
    pairs = spark.createDataFrame([("INTEGER", "serial"), ("TEXT", "text"), ("TEXT", "SERIAL")], "a string, b string")
    assert [r[0] for r in pairs.select(types.same_type(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_created_table(spark):
    cases = {
        'CREATE TABLE "meta"."users" (id SERIAL);': "meta.users",
        "create table  if not exists\n meta.a__b (x int)": "meta.a__b",
        'CREATE TABLE "test0".help__theme (x int)': "test0.help__theme",
        'CREATE TABLE meta."Users" (x int)': "meta",
        "CREATE TABLE plain (x int)": "plain",
        "SELECT * FROM users;": None,
        "-- this file is intentionally empty": None,
    }
    assert column(spark, list(cases), ddl.created_table) == list(cases.values())


def test_referenced_tables(spark):
    cases = {
        'x REFERENCES meta.lucide_icon ("ID")': ["meta.lucide_icon"],
        'x REFERENCES "test00000000000000000000".help__theme ("ID")': ["test00000000000000000000.help__theme"],
        'a REFERENCES meta.group ("ID"), b REFERENCES meta.user ("ID")': ["meta.group", "meta.user"],
        'p REFERENCES meta.own ("ID")': [],
        'x references meta.a ("ID") ON DELETE CASCADE': ["meta.a"],
        'x REFERENCES meta.a("ID")': ["meta.a"],
        'a REFERENCES meta.a ("ID"), b REFERENCES meta.a ("ID")': ["meta.a"],
        'FOREIGN KEY (a, b) REFERENCES meta.a ("A", "B")': ["meta.a"],
        "REFERENCES nodot (x)": [],
    }
    assert column(spark, list(cases), lambda c: ddl.referenced_tables(c, F.lit("meta.own"))) == list(cases.values())
    assert column(spark, ['p REFERENCES meta.own ("ID")'], ddl.referenced_tables) == [["meta.own"]]


def test_reference_parts(spark):
    got = column(spark, ["a.b.c", "a.b", "a.b.c.d", None], ddl.reference_parts)
    assert [tuple(g) if g else None for g in got] == [("a", "b", "c"), None, None, None]


def test_lines_of_matches(spark):
    content = "x\n>Ab</ y >\n\n C\nd</\n\x01>e</>f</"
    expected = [(m.group(0), content[: m.start()].count("\n") + 1) for m in re.finditer(r">([^<]{1,}?)</", content)]
    expected = [(m, n, content.split("\n")[n - 1]) for m, n in expected]
    (got,) = column(spark, [content], lambda c: text.matches_with_lines(c, r">([^<]++)</"))
    assert [tuple(g) for g in got] == expected


def test_key_calls(spark):
    code = "t('a') t(\"b\") tNav('c') split('d') t('a') t(`e`) _t('f') ét('g') t('') (t('h'))"
    (got,) = column(spark, [code], components.used_keys)
    assert got == list(dict.fromkeys(re.findall(r"\bt(?:[A-Z]\w*)?\(['\"]([^'\"]+)['\"]\)", code)))
    (got,) = column(spark, ["const { t : tNav } = useTranslation('x/y'); useTranslation(\"x/y\")"], components.bundle_calls)
    assert got == ["x/y", "x/y"]
    (got,) = column(spark, ["{ t: tTest } {t:tB} { t: other }"], components.aliases)
    assert got == ["tTest", "tB"]
    assert column(spark, ["useTranslation", "t('x')", "split('x')"], components.uses_translations) == [True, True, False]


def test_folders(spark):
    assert column(spark, ["a/b/c.tsx", "c.tsx"], components.folder_of) == ["a/b", "."]
    assert column(spark, ["a/b", "."], components.ancestors) == [[".", "a", "a/b"], ["."]]


def test_hardcoded_text_is_kept_or_dropped(spark):
    kept = '<label>Save it</label>\n<button>Go now</button><input placeholder="your name"/>'
    (got,) = column(spark, [kept], components.hardcoded_text)
    assert [(g["kind"], g["text"], g["line"]) for g in got] == [
        ("jsx_text_node", "Save it", 1),
        ("jsx_text_node", "Go now", 2),
        ("attribute_placeholder", "your name", 2),
        ("button_text", "Go now", 2),
    ]
    dropped = [
        "<p>lower case</p>", "<p>{name}</p>", "<p>Hi</p>", "<p>LOADING...</p>", '<i title="$variable"/>', '<i title="@mention"/>',
        '<i title="callback()"/>', '<i title=""/>', "<p>Go</p>", "<button>SUBMIT NOW</button>", "<button>  \n </button>",
    ]
    assert column(spark, dropped, components.hardcoded_text) == [[]] * len(dropped)


def test_content_types(spark):
    known = mimetypes.MimeTypes(filenames=())
    paths = ["a.txt", "b/c.HTML", "x.tar.gz", "x.tgz", "x.svgz", "p.JPG", "noext", ".bashrc", "a.b/c", "x.gz", "x.unknown", "d.json", "q.", "..x.png"]
    assert column(spark, paths, content_type) == [known.guess_type(p)[0] for p in paths]


def test_created_table_stops_at_the_first_match(spark):
    """The text behind the first CREATE TABLE is not searched for another."""
    from tallyfold.functions.ddl import created_table

    texts = ['create table if not exists "m"."a b" (x int); CREATE TABLE c (i)', "CREATE TABLE IF (x)", "nothing", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", created_table(F.col("t")).alias("name"))
    assert [r["name"] for r in found.orderBy("i").collect()] == ["m.a b", "IF", None, None]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
