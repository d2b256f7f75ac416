"""Every operator on texts that are NULL, empty, repeated or short, on empty tables and on tables with other columns."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import decontamination, embeddings, language, language_model, near_duplicates, packing, phrases, quality, registry, sharding, substrings, toxicity, urls, variants
from tallyfold.llm.common import parts
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
DOCS = [
    (1, LONG, "en", "a"),
    (2, LONG + " tail", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "fr", "b"),
    (6, "short text", "en", "b"),
    (7, "x1 " + PASSAGE + " y1", "en", "b"),
    (8, "x2 x3\u00a0z " + PASSAGE, "de", "b"),
    (9, LONG, "en", "c"),
    (9, LONG, "en", "c"),
    (None, "no id here", "en", "c"),
    (10, "spam " * 500, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, name string, host string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*d, len(d[1] or ""), "s", "n", "h") for d in DOCS], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == ""


def test_every_operator_has_one_query():
    assert sorted(registry.queries(), key=lambda x: int(x[2:].split("_")[0])) == [n for n in registry.queries()]
    assert len(registry.queries()) == 13


def test_substrings(docs):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept").collect()]
    by_id = {r[0]: r for r in got}
    assert len(got) == len(DOCS)
    assert by_id[1][1:] == (3000, 3000, "") and by_id[2][1:] == (3001, 3000, "tail")
    assert by_id[3][1:] == (0, 0, "") == by_id[4][1:] == by_id[5][1:]
    assert by_id[6][1:] == (2, 0, "short text")
    assert by_id[7][3] == "x1 y1" and by_id[8][3] == "x2 x3\u00a0z"
    assert by_id[10][1:] == (500, 500, "")
    assert corpus_pipeline.substring_dedup(None, docs, "").columns == docs.columns
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    names = ("kept", "n_words", "n_removed", "kept_sha256", "_name", "firsts", "bits", "row")
    other = docs.withColumns({n: F.lit(n) for n in names})
    assert corpus_pipeline.substring_dedup(None, other, "").columns == other.columns
    million = docs.limit(1).withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 500000), x -> concat('w', x)), 'again', transform(sequence(1, 500000), x -> concat('w', x)))"))
    row = substrings.without_repeats(million).first()
    assert (row["n_words"], row["n_removed"], row["kept"]) == (1_000_001, 1_000_000, "again")


def test_near_duplicates(docs):
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert classes[1] == classes[2] == classes[9] == 1
    assert [classes[i] for i in (3, 4, 5, 6, 10)] == [3, 4, 5, 6, 10]
    assert sum(r["kept"] for r in got if r["class_id"] == 1) == 1
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 9)").count() == 1
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    other = docs.withColumns({"_id": F.lit(1), "_hash": F.lit(2), "gone_id": F.lit(3), "row": F.lit(4)})
    assert near_duplicates.one_of_each(other).columns == other.columns


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    """Groups of near copies around the threshold, in small blocks; classes are those of all similar pairs."""
    random = np.random.default_rng(10)
    vocabulary = np.array([f"v{i}" for i in range(400)])
    texts = []
    for _ in range(6):
        base = random.choice(vocabulary, 120)
        for _ in range(12):
            text = base.copy()
            at = random.choice(120, random.integers(0, 4), replace=False)
            text[at] = random.choice(vocabulary, len(at))
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(docs))
    weighed = [near_duplicates.weighted(near_duplicates.Words(pa.array([t])).hashes(), idf) for t in texts]
    linked = np.array([[near_duplicates.similarity(a, b) >= 0.8 for b in weighed] for a in weighed])
    monkeypatch.setattr(near_duplicates, "CHUNK", 5)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == near_duplicates.least_linked(linked).tolist()


def test_all_similar_is_weighted_jaccard():
    random, idf = np.random.default_rng(1), np.linspace(1, 5, 64).astype(np.float32)
    base = random.integers(0, 1 << 60, 200).astype(np.uint64)
    texts = [np.where(random.random(200) < share, random.integers(0, 1 << 60, 200).astype(np.uint64), base) for share in (0, 0.01, 0.02, 0.05, 0.3)]
    texts.append(np.concatenate([base, base[:50]]))
    counted = [near_duplicates.counted(t, idf) for t in texts]
    pairs = [(n, e * c) for n, e, c in counted]
    for least in (0.3, 0.8):
        expected = [[near_duplicates.similarity(a, b) >= least for b in pairs] for a in pairs]
        assert (near_duplicates.all_similar(counted, least) == np.array(expected)).all()


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "P0 p1, " + PASSAGE[6:]), (2, "a b"), (3, None), (None, PASSAGE)], "item_id long, text string")
    found = {(r["item_id"], r["n_shared"] == r["n_shingles"]) for r in decontamination.leaks(docs, items).collect()}
    assert found == {(1, True)}
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 2
    assert decontamination.leaks(docs, items.limit(0)).count() == 0 == decontamination.leaks(docs.limit(0), items).count()
    # Items of under five words are found by their own length; slices of the index change nothing.
    short = spark.createDataFrame([(1, "Short text"), (2, "text short"), (3, "here"), (4, ""), (5, PASSAGE)], "item_id long, text string")
    for rows in (1, 7, 1000):
        got = {(r["item_id"], r["n_shared"]) for r in decontamination.leaks(docs, short, slice_rows=rows).collect()}
        assert got == {(1, 1), (3, 1), (5, 56)}
    other = docs.withColumns({"_leak": F.lit(1), "text_hash": F.lit(2), "row": F.lit(3)})
    assert decontamination.clean(other, items).columns == other.columns


def test_packing(docs):
    pieces = packing.packed(docs).toPandas()
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 2048
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    encode = packing.encoder(packing.tokenizer_path())
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    for doc_id, text, *_ in DOCS:
        ids = slow.encode(text or "", add_special_tokens=False).ids + [1]
        assert (encode(text) if text else b"") == np.array(ids[:-1], "<u4").tobytes()
        for row in pieces[pieces.doc_id == doc_id].itertuples():
            assert row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(np.array(ids[row.start : row.start + row.length], "<u4").tobytes())
    assert len(pieces[pieces.doc_id == 9]) == 2 * len(pieces[pieces.doc_id == 1])
    assert packing.packed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a\n b", "a <|endoftext|> b", "it's 12 \u00e9t\u00e9\u00b2 \u4e2d\u6587", "a\x1c b", "tab\tb \n"])
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    assert packing.encoder(packing.tokenizer_path())(text) == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_places_everything():
    random = np.random.default_rng(2)
    histogram = {int(s) * 16: int(n) for s, n in zip(range(1, 60, 3), random.integers(0, 400, 20), strict=True)}
    plan = packing.planned(dict(histogram))
    placed: dict[int, int] = {}
    for times, counts in plan:
        assert sum(s * c for s, c in counts.items()) <= 2048
        for s, c in counts.items():
            placed[s] = placed.get(s, 0) + times * c
    assert placed == {s: n for s, n in histogram.items() if n}
    assert sum(t for t, _ in plan) * 2048 <= 1.02 * sum(s * n for s, n in histogram.items()) + 2048


def test_language_model(spark, docs):
    rows = language_model.scored(docs.selectExpr("doc_id", "text", "doc_id in (2, 6) as held_out")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(DOCS)
    assert (by_id[3]["n_tokens"], by_id[4]["n_tokens"], by_id[6]["n_tokens"], by_id[6]["n_known"]) == (1, 1, 3, 1)
    assert all(r["score"] <= 0 and np.isfinite(r["score"]) for r in rows)
    assert language_model.scored(docs.selectExpr("doc_id", "text", "false as held_out").limit(0)).count() == 0


def test_discounts():
    exact = language_model.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 45})
    assert ((exact[1:6] > 0) & (exact[1:6] < 1)).all() and exact[6] == 1
    assert (language_model.discounts({1: 3})[1:6] == 1 - 0.5 / np.arange(1, 6)).all()


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 1, 1), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs.select("doc_id", "text", "name"), docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = toxicity.scored(docs.select("doc_id", "text"), docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_toxicity_knows_rare_words(spark):
    texts = [f"common words here plain{i}" for i in range(30)] + [f"common words here vile{i // 2}" for i in range(6)] + ["vile1 unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(36)], "doc_id long, toxic int")
    last = toxicity.scored(docs, docs.where("doc_id < 36"), labels).where("doc_id = 36").first()
    assert last["evidence"][0]["toxic"] == 1 and last["evidence"][0]["doc_id"] in ("32", "33")


def test_toxicity_takes_repeated_examples_as_often_as_they_come(spark):
    texts = [(1, "vile words"), (1, "vile words"), (1, "other text"), (2, "plain words"), (2, None), (None, "no id"), (3, "unlabelled")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.Model(docs, labels, 10)
    assert sorted(zip(model.names, model.toxic.tolist(), strict=True)) == [("1", 1.0)] * 3 + [("2", 0.0)] * 2
    assert (toxicity.Model(docs, labels, 2).stands_for == [1.5, 1.5, 1, 1]).all()


def test_index_finds_the_nearest():
    random = np.random.default_rng(3)
    examples = []
    for _ in range(300):
        term = np.sort(random.choice(40, random.integers(0, 6), replace=False))
        weight = random.random(len(term)) + 0.1
        examples.append((term, weight / np.linalg.norm(weight) if len(term) else weight))
    index, dense = toxicity.Index(examples, 40), np.zeros((300, 40))
    for i, (term, weight) in enumerate(examples):
        dense[i, term] = weight
    for i in range(0, 300, 7):
        names, cosines = index.nearest(*examples[i])
        all_ = np.round(dense @ dense[i], 9)
        order = np.lexsort((np.arange(300), -all_))
        expected = [j for j in order if all_[j] > 0][: toxicity.NEIGHBOURS]
        assert np.allclose(cosines, all_[expected]) and set(names) == set(expected)


def test_index_finds_the_nearest_with_few_frequent_terms(monkeypatch):
    random = np.random.default_rng(5)
    examples = []
    for i in range(700):
        term = np.unique(np.append(random.choice(400, random.integers(0, 9)), random.choice(6, 2) + 20 * (i % 20)))
        weight = random.random(len(term)) + 0.1
        examples.append((term, weight / np.linalg.norm(weight)))
    dense = np.zeros((700, 400))
    for i, (term, weight) in enumerate(examples):
        dense[i, term] = weight
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    for frequent in (0, 7, 400):
        monkeypatch.setattr(toxicity, "FREQUENT", frequent)
        found = toxicity.Index(examples, 400).all_nearest(examples, leave_out=True)
        for i, (names, cosines) in enumerate(found):
            all_ = np.round(dense @ dense[i], 9)
            order = np.lexsort((np.arange(700), -all_))
            expected = [j for j in order if all_[j] > 0 and j != i][: toxicity.NEIGHBOURS]
            assert np.allclose(cosines, all_[expected]) and len(names) == len(expected) and i not in names
        assert i == 699


def test_terms_of_whole_batches():
    words = [b"(Vile!)", "\u00dcn\u00efc\u00f6d\u00e9s".encode(), "\u03a3\u0391\u03a3.".encode(), b"...", b"abcd~", b"x\xff\xfeyzabc", b"caf\xc3", "\u65e5\u672c\u8a9e".encode() * 4, b"abcdefgh"]
    hashes, owner = toxicity.terms_of(pa.array(words, pa.large_binary()))
    alone = [toxicity.terms_of(pa.array([w], pa.large_binary()))[0] for w in words]
    assert [set(hashes[owner == i].tolist()) for i in range(len(words))] == [set(x.tolist()) for x in alone]
    assert [len(set(x.tolist())) for x in alone] == [1, 5, 1, 0, 1, 3, 1, 5, 5]
    lower, _ = toxicity.terms_of(pa.array([b"vile"], pa.large_binary()))
    assert set(lower.tolist()) == set(alone[0].tolist())
    # The mark of a beginning: "abcd~" is the beginning of "abcdefgh" too, as ever.
    assert set(alone[4].tolist()) <= set(alone[8].tolist())


def test_parts_keep_every_row():
    texts = ["a" * 5, None, "", "b" * 40, "\u00e9" * 3, "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    for most in (1, 6, 7, 1000):
        cut = list(parts([batch, batch.slice(0, 0), batch.slice(3)], "text", most))
        assert [r["text"] for part in cut for r in part.to_pylist()] == texts + texts[3:]
        assert all(len(part) and (len(part) == 1 or sum(len((r["text"] or "").encode()) for r in part.to_pylist()) <= most) for part in cut)


def test_batches_of_long_texts_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 100000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    given = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        substrings.without_repeats(docs.limit(1))
        assert max(r[0] for r in docs.mapInArrow(sizes, "size long").collect()) < 8 << 20
        spark.conf.set(name, "16m")
        substrings.without_repeats(docs.limit(1))
        assert spark.conf.get(name) == "16m"
    finally:
        spark.conf.set(name, given) if given else spark.conf.unset(name)


def test_language(docs):
    got = {r["doc_id"]: r for r in language.identified(docs.selectExpr("doc_id", "text", "lang as declared", "source as host", "name"), language.trained(docs)).collect()}
    assert [got[i]["accepted"] for i in (3, 4, 5)] == [False] * 3 and got[6]["lang"] == "en"
    assert language.accepted_documents(docs).columns == docs.columns
    assert language.accepted_documents(docs.limit(0)).count() == 0


def test_urls(spark):
    pages = [
        (1, "http://a.Example.NET/en/x?q=1"), (2, "http://a.example.net/fr/x"), (3, "https://example.com/de/1"), (4, "https://notexample.com/de/1"),
        (5, "x://b.org/fr/#t"), (6, None), (7, "no scheme"), (8, "http://c.net"), (8, "http://c.net"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'v' as verdict", "'r' as rule")
    labelled = spark.createDataFrame([(f"http://bad.site.com/en/{i}", "block") for i in range(9)] + [(f"http://good.site.org/en/{i}", "allow") for i in range(9)], "url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(frame, labelled).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2] is None
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "allow") == got[7] and got[8][1:3] == ("", None)
    mined = urls.judged(spark.createDataFrame([(1, "http://bad.site.com/de/5")], "page_id long, url string"), labelled).first()
    assert mined["verdict"] == "block" and "host=bad.site.com" in mined["method_rule"]
    assert urls.judged(frame, labelled.limit(0)).count() == len(pages)


def test_rare_bad_host_becomes_a_rule(spark):
    good = [(f"http://h{i % 50}.good{i % 50}.com/a/{i}", "block" if i % 25 == 0 else "allow") for i in range(1500)]
    labelled = spark.createDataFrame([*good, *((f"http://www.rare.com/a/{i}", "block") for i in range(8))], "url string, verdict string")
    asked = spark.createDataFrame([("http://www.rare.com/a/99",), ("http://h1.good1.com/a/99",)], "url string")
    got = {r["url"]: r["verdict"] for r in urls.judged(asked, labelled).collect()}
    assert got == {"http://www.rare.com/a/99": "block", "http://h1.good1.com/a/99": "allow"}


def test_urls_of_many_keys_are_mined_in_bounded_work(spark):
    query = "&".join(f"k{i}={i}" for i in range(30))
    labelled = [(f"http://x.y{i}.com/a/b.php?{query}", "block") for i in range(5)] + [(f"http://w.z{i}.com/a/b.html", "allow") for i in range(40)]
    frame = spark.createDataFrame(labelled, "url string, verdict string")
    rules = urls.mined(frame).collect()
    assert rules and all(sum(x.startswith("query=") for x in r["items"]) <= 1 for r in rules) and len(rules) < 2000
    asked = spark.createDataFrame([("http://q.r.com/c?k7=1", "extra")], "url string, _url string")
    got = urls.judged(asked, frame).first()
    assert got["verdict"] == "block" and got["method_rule"] == "query=k7" and got["_url"] == "extra"
    assert urls.judged(asked.limit(0), frame).count() == 0


PHRASES = [
    (1, "New York is new york. New York, new york city", "en"),
    (2, "new york city! new\tyork city x\nnew york", "en"),
    (3, "des pommes de terre; pommes de terre", "fr"),
    (4, None, "en"),
    (5, "", None),
    (6, "a b a b a b", None),
    (6, "a b a b a b", "und"),
]


def _phrases_by_hand(rows, least):
    import re

    f, n = {}, {}
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").lower()):
            words = re.findall("[^ \t]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i : i + size]))
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (x, q), b in candidates.items())
        if not inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p), l, r))
    return sorted((lang, i, p, -a, l, r, n[lang], -score) for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found), start=1))


@pytest.mark.parametrize("width", [64, 3])
def test_phrases(spark, width):
    """With fingerprints of three bits most keys collide, and the result stays the same."""
    frame = spark.createDataFrame([(*r, "x") for r in PHRASES], "doc_id long, text string, lang string, key string")
    got = phrases.collocations(frame, least=2, width=width, bits=1 << 10).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == _phrases_by_hand(PHRASES, 2)
    assert phrases.collocations(frame.limit(0), least=2).count() == 0


def test_a_long_text_of_phrases(spark):
    text = " ".join(f"w{i % 997} x" for i in range(120_000))
    frame = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = phrases.collocations(frame).collect()
    assert len(got) == len(phrases.collocations(frame.repartition(3)).collect()) and all(r["n"] == 240_000 for r in got)


def test_variants_by_brute_force(spark):
    random = np.random.default_rng(8)
    letters = list("abcdeßéÿ")
    words = {}
    for _ in range(120):
        word = "".join(random.choice(letters[: random.integers(2, 9)], random.integers(7, 12)))
        words[word] = int(random.integers(20, 400))
        for _ in range(4):
            i, c = int(random.integers(len(word))), str(random.choice(letters))
            other = [word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word + c][int(random.integers(4))]
            if len(other) >= 7:
                words.setdefault(other, int(random.integers(2, 40)))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    expected = {}
    for w, n in words.items():
        beside = [x for x in words if x != w and near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        expected[w] = (best if best and words[best] >= 10 * n else None, n, len(beside))

    def root(w):
        return root(expected[w][0]) if expected[w][0] else w

    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for share in (1, 40, 1 << 15):  # from no frequent run to many
        got = {r["word"]: tuple(r)[1:] for r in variants.grouped(frame, share=share).collect()}
        assert got == {w: (form, root(w), n, count, words[form] if form else None) for w, (form, n, count) in expected.items()}


def test_variants_of_texts(spark):
    import zlib

    docs = [(1, "Strassenbahn strassenbahn ÀÉÿabcd àéÿabcd tooslow", "x"), (None, None, "x"), (None, "strassenbahn " * 3, "x"), (2, "", "x"), (1, "strassenbahn", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string")
    counts = {}
    for doc_id, text, _ in docs:
        for run in variants.RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[run] = counts.get(run, 0) + 1
    got = {r["word"]: r["n"] for r in variants.variants(frame).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert variants.variants(frame.limit(0)).count() == 0
    text = "ab" * 900_000 + " " + "wort" * 3
    assert variants.runs_of(text) == {"ab" * 900_000: 1, "wortwortwort": 1}


def test_quality_learns_and_is_held_out(spark):
    random = np.random.default_rng(9)
    good, bad = [f"word{i}" for i in range(60)], [f"junk{i}***" for i in range(60)]
    rows = [(i, " ".join(random.choice(good if i % 3 else bad, 40)), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "word1", "x"), (5, rows[5][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.scored(docs, docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0")).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    held = [(by_id[i], y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    none = quality.scored(docs, docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.scored(docs.limit(0), docs, labels).count() == 0


def test_word_buckets_are_those_of_each_word():
    words = ["über".encode(), b"ab", b"a", b"\xff\xfe", "日本語".encode()]
    bucket, place = quality.word_buckets(words)
    for i, word in enumerate(words):
        alone, _ = quality.word_buckets([word])
        assert sorted(bucket[place == i]) == sorted(alone)
    assert len(bucket[place == 2]) == 2 and len(quality.word_buckets([])[0]) == 0  # the word itself and <a>


def test_embeddings(spark):
    random = np.random.default_rng(4)
    base = random.standard_normal(16)
    vectors = [base, base, base * 3, -base, base + 0.05 * random.standard_normal(16), np.zeros(16), np.full(16, np.nan), np.ones(8)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(8, None), (9, []), (10, [1.0, None])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[0] == (3, 0, True) and got[1] == (3, 0, False) and got[2] == (3, 0, False) and got[4] == (3, 0, False)
    assert all(got[i] == (0, i, True) for i in (3, 5, 6, 7, 8, 9, 10))


def _near_pairs(random, n, length, used, cosine):
    """``n`` pairs of unit vectors of a given cosine, with weight in the first ``used`` coordinates only."""
    a, b = np.zeros((n, length)), np.zeros((n, length))
    a[:, :used], b[:, :used] = random.standard_normal((n, used)), random.standard_normal((n, used))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, np.asarray(cosine).reshape(-1, 1) * a + np.sqrt(1 - np.asarray(cosine).reshape(-1, 1) ** 2) * b


@pytest.mark.parametrize("used", [64, 40, 32, 16])
@pytest.mark.parametrize("side", [90, 284])
def test_filters_find_pairs_wherever_their_weight_is(used, side):
    a, b = _near_pairs(np.random.default_rng(6), 400, 64, used, 0.9)
    code = embeddings.Code(64, side, 0.9)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.filters(a), code.filters(b), strict=True)]
    assert np.mean(met) >= 0.97


@pytest.mark.parametrize("length", [16, 64])
def test_filters_find_pairs_just_above_the_linking_cosine(length):
    random = np.random.default_rng(7)
    a, b = _near_pairs(random, 4000, length, length, random.uniform(0.9, 0.92, 4000))
    code = embeddings.Code(length, 90, 0.9)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.filters(a), code.filters(b), strict=True)]
    assert np.mean(met) >= 0.998


def test_filters_are_all_that_are_exceeded():
    unit = embeddings._unit(np.random.default_rng(11).standard_normal((50, 24)))
    code = embeddings.Code(24, 64, 0.9)
    for i, found in enumerate(code.filters(unit)):
        expected = []
        for n, one in enumerate(code.codes):
            x, y = one.products(unit[i : i + 1])
            sums = (x[0][:, None] + y[0][None, :]).ravel()
            over = np.flatnonzero(sums >= min(one.alpha, sums.max()) - 1e-12)
            expected += (over + n * 64 * 64).tolist()
        assert found.tolist() == sorted(expected)


def test_links_just_above_the_cosine(spark):
    """Pairs between cosine 0.9 and 0.92 through the whole operator, against brute force."""
    random = np.random.default_rng(12)
    a, b = _near_pairs(random, 400, 32, 32, random.uniform(0.9, 0.92, 400))
    vectors = np.concatenate([a, b])
    linked = embeddings._unit(vectors) @ embeddings._unit(vectors).T >= 0.9
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node string")
    got = {r["vec_id"]: r for r in embeddings.linked_vectors(frame).collect()}
    found = np.array([got[i]["n_links"] for i in range(800)])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.998 * linked.sum()
    assert embeddings.linked_vectors(frame.limit(0)).count() == 0


def test_chunks_change_nothing(spark, monkeypatch):
    random = np.random.default_rng(5)
    base = random.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.35 * random.standard_normal(16)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = embeddings._unit(np.array([r[1] for r in rows]))
    degree = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    monkeypatch.setattr(embeddings, "CHUNK", 7)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.linked_vectors(frame).collect()}
    found = np.array([got[i] for i in range(60)])
    assert (found <= degree).all() and found.sum() >= 0.97 * degree.sum()


def test_sharding(docs):
    owner = sharding.filled(sharding.SHARDS, sharding.SLOTS)
    share = np.bincount(owner)
    assert share.max() - share.min() <= 1
    fewer = sharding.filled(sharding.SHARDS[:-1], sharding.SLOTS)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * sharding.SLOTS
    placed = sharding.placed(docs)
    assert placed.count() == len(DOCS) and placed.where("doc_id = 9").select("shard").distinct().count() == 1
    with pytest.raises(ValueError, match="prime"):
        sharding.filled(("a",), 10)


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(pieces) and pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
