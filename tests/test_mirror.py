"""Inventories: difference, application, manifests, file lists and snapshots."""

from __future__ import annotations

from tallyfold.operators.mirror import bucket_list, manifest, mirror_apply, mirror_counts, mirror_diff, mirror_run, mirror_totals
from tallyfold.operators.snapshot import files_to_delete, snapshot_counts, snapshot_diff
from tallyfold.schemas import INVENTORY
from tallyfold.sinks.lines import numbered_lines, read_lines, write_lines
from tallyfold.sources.corpus import read_corpus
from tallyfold.sources.files import is_component, list_files, named


def inventory(spark, *rows):
    return spark.createDataFrame(list(rows), INVENTORY)


def test_mirror_steps(spark, rows):
    a, b = ("etl", "user/file-a.txt", 11), ("etl", "user/file-b.txt", 7)
    remote = inventory(spark, a, b)
    first = mirror_diff(remote, inventory(spark))
    assert rows(first, "key", "action") == [(a[1], "download"), (b[1], "download")]
    local = mirror_apply(remote, inventory(spark))
    assert rows(local) == rows(remote)
    changed = inventory(spark, a, ("etl", b[1], 1))
    assert rows(mirror_counts(mirror_diff(remote, changed))) == [("etl", 1, 0)]
    gone = inventory(spark, b)
    assert rows(mirror_diff(gone, local), "key", "action") == [(a[1], "delete"), (b[1], "keep")]
    assert rows(mirror_apply(gone, local)) == rows(gone)


def test_system_files_and_other_buckets_stay(spark, rows):
    remote = inventory(spark, ("x", "a", 1), ("y", "b", 2))
    local = inventory(spark, ("x", "d/.objects", 5), ("x", "old", 3), ("y", "c", 1), ("z", "c", 1))
    after = mirror_apply(remote, local, ["x", "absent"])
    assert rows(after) == [("x", "a", 1), ("x", "d/.objects", 5), ("y", "c", 1), ("z", "c", 1)]
    assert rows(mirror_diff(remote, local, ["x"]), "key", "action") == [("a", "download"), ("old", "delete")]
    existing = spark.createDataFrame([("z",)], "bucket string")
    assert rows(mirror_diff(remote, local, ["z"], existing), "bucket", "key", "action") == [("z", "c", "delete")]


def test_manifest(spark, rows):
    got = manifest(inventory(spark, ("m", "a/b/c.txt", 1), ("m", "a/d.txt", 1), ("m", "e.txt", 1)))
    assert rows(got) == [("m", "", "a"), ("m", "", "e.txt"), ("m", "a", "b"), ("m", "a", "d.txt"), ("m", "a/b", "c.txt")]
    listed = bucket_list(inventory(spark, ("m", "a", 1)), spark.createDataFrame([("m",), ("old",)], "bucket string"))
    assert rows(listed) == [("m",), ("old",)]


def test_listing_a_tree(spark, rows, tmp_path):
    for path in ("meta/a/seed.csv", "meta/catalog/seed.csv", "u1/b/seed.csv", "u1/b/create.sql"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x\r\ny")
    roots = [str(tmp_path / d) for d in ("meta", "u1", "absent")]
    found = named(list_files(spark, roots, "seed.csv"), "seed.csv", without="meta/catalog/seed.csv")
    assert [r[0].rsplit("/", 3)[1:] for r in rows(found, "path")] == [["meta", "a", "seed.csv"], ["u1", "b", "seed.csv"]]
    assert rows(found, "size") == [(4,), (4,)]
    assert list_files(spark, [str(tmp_path / "absent")]).count() == 0
    corpus, failed = read_corpus(spark, [str(tmp_path / "u1"), str(tmp_path / "absent")], str(tmp_path))
    assert rows(failed) == []
    assert rows(corpus) == [("u1/b/create.sql", "u1/b", "create.sql", "x\ny"), ("u1/b/seed.csv", "u1/b", "seed.csv", "x\ny")]


def test_files_that_give_no_text(spark, rows, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in (("good.txt", b"x\r\ny"), ("bad.txt", b"\xff\xfe"), (".hidden", b"h"), ("large.txt", b"0123456789"), ("empty.txt", b"")):
        (tmp_path / "a" / name).write_bytes(content)
    corpus, failed = read_corpus(spark, [str(tmp_path)], str(tmp_path), largest=8)
    assert rows(corpus, "path", "content") == [("a/empty.txt", ""), ("a/good.txt", "x\ny")]
    assert rows(failed) == [("a/.hidden", "hidden"), ("a/bad.txt", "not valid UTF-8"), ("a/large.txt", "too large")]
    assert [r[0].rsplit("/", 1)[-1] for r in rows(list_files(spark, [str(tmp_path)], ".hidden"), "path")] == [".hidden"]


def test_run_of_a_mirror(spark, rows):
    remote, local = inventory(spark, ("x", "a", 1), ("x", "b", 2), ("y", "c", 3)), inventory(spark, ("x", "b", 2), ("x", "old", 3))
    existing = spark.createDataFrame([("x",), ("y",), ("empty",)], "bucket string")
    assert rows(mirror_totals(mirror_diff(remote, local, existing=existing), existing)) == [(None, 2, 1), ("empty", 0, 0), ("x", 1, 1), ("y", 1, 0)]
    assert rows(mirror_run(remote, local, existing=existing)) == [("success", "3 buckets mirrored: 2 objects fetched, 1 removed", 3, 2, 1, 1)]
    assert rows(mirror_run(remote, remote)) == [("success", "2 buckets mirrored: 0 objects fetched, 0 removed", 2, 0, 0, 3)]


def test_lines_have_their_numbers(spark, rows, tmp_path):
    texts = [f"{i * 37 % 101:03d}" for i in range(101)] + ["", "050"]
    lines = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    expected = list(enumerate(sorted(texts), start=1))
    assert rows(numbered_lines(lines, ["text"]), "line", "text") == expected
    write_lines(lines, str(tmp_path / "t"), ["text"])
    assert rows(read_lines(spark, str(tmp_path / "t")), "line", "text") == expected
    assert rows(numbered_lines(lines.limit(0), ["text"])) == []


def test_component_files(spark, rows):
    kept = ["a/B.tsx", "utils/C.tsx", "a/d.ts", "providers/E.tsx"]
    dropped = ["a/B.test.tsx", "a/b.spec.ts", "a/types.ts", "a/b.d.ts", "utils/x.ts", "a/providers/x.ts", "a/x.js"]
    df = spark.createDataFrame([(p,) for p in kept + dropped], "path string")
    assert rows(df.where(is_component(df.path))) == [(p,) for p in sorted(kept)]


def test_snapshot(spark, rows):
    def names(*n):
        return spark.createDataFrame([(x,) for x in n], "table string")

    diff = snapshot_diff(names("m.new", "m.both__x", "u.other"), names("m.old", "m.both__x"), ["m"])
    assert rows(diff, "table", "action") == [("m.both__x", "update"), ("m.new", "create"), ("m.old", "delete")]
    assert rows(snapshot_counts(diff)) == [("create", 1), ("delete", 1), ("update", 1)]
    files = spark.createDataFrame([("m/old/create.sql",), ("m/old/seed.csv",), ("m/both/x/create.sql",)], "path string")
    assert rows(files_to_delete(diff, files)) == [("m/old/create.sql",), ("m/old/seed.csv",)]
    assert len(rows(snapshot_diff(names("m.a"), names("u.b")))) == 2
