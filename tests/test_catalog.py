"""A file tree to a catalog to an index."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.sources import files as files_module
from shelfmark.operators.routing import Registry


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    contents = {
        "top.txt": b"hello the world\r\nand the rest", "a/x.md": b"\xff\xfe bytes", "a/.hid/z.txt": b"no",
        "a/skip/keep.txt": b"pruned", "pkg/__init__.py": b"import os\n\n\ndef f():\n    pass\n", "t.csv": b"p,q\n1,2\n",
        "t.json": b'[{"a": 1}, {"a": 2}]', "c.yml": b"a: [1, 2]\n", ".dot": b"x",
    }
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root), contents


def test_scan_with_all_names(spark, tree):
    root, contents = tree
    got = {r["path"]: r for r in sm.scan_files(spark, root, with_content=True, hidden=True).collect()}
    assert {p[len(root) + 1:]: bytes(r["content"]) for p, r in got.items()} == contents
    r = got[f"{root}/a/skip/keep.txt"]
    assert (r["depth"], r["filename"], r["size_bytes"]) == (2, "keep.txt", 6)
    assert abs(r["modified_at"].timestamp() - os.stat(r["path"]).st_mtime) < 1


@pytest.mark.parametrize("hidden, left_out", [(None, "."), (False, "._")])
def test_plain_scan_leaves_out_hidden_names(spark, tree, hidden, left_out):
    root, contents = tree
    got = {r["path"][len(root) + 1:]: r["size_bytes"] for r in sm.scan_files(spark, root, hidden=hidden).collect()}
    assert got == {n: len(c) for n, c in contents.items() if not any(p[0] in left_out for p in n.split("/"))}


@pytest.mark.parametrize("hidden", [None, False])
def test_only_what_a_profile_takes_is_read(spark, tree, hidden):
    root, _ = tree
    os.makedirs(f"{root}/node_modules")
    for name, size in (("node_modules/big.bin", 5000), ("raw.bin", 5000), ("long.txt", 4000)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(b"x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "3000")
    try:
        catalog = sm.build_catalog(spark, root, hidden=hidden, select={"exclude_globs": ["node_modules"]}, keep_profiles=True)
        got = {r["path"][len(root) + 1:]: r for r in catalog.collect()}
        errors = sm.catalog_errors(catalog).where("profile = 'content'").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert "node_modules/big.bin" not in got and got["raw.bin"]["read_error"] is None
    assert got["long.txt"]["read_error"] == "longer than 3000 bytes; not read"
    assert [r["path"][len(root) + 1:] for r in errors] == ["long.txt"]
    assert got["top.txt"]["line_count"] == 2


def test_missing_root_and_unreadable_files(spark, tree, tmp_path):
    root, _ = tree
    with pytest.raises(FileNotFoundError):
        sm.scan_files(spark, str(tmp_path / "none"))
    scanned = sm.scan_files(spark, root)
    os.remove(f"{root}/top.txt")  # gone between listing and reading
    from shelfmark.sources.files import with_bytes

    got = {r["path"][len(root) + 1:]: r["read_error"] for r in with_bytes(scanned, F.lit(True)).collect()}
    assert got.pop("top.txt") == "could not be read" and set(got.values()) == {None}


@pytest.mark.parametrize("hidden", [False, True, None])
def test_build_catalog(spark, tree, hidden):
    root, _ = tree
    catalog = sm.build_catalog(spark, root, hidden=hidden, select={"exclude_globs": ["skip"]})
    got = {r["path"][len(root) + 1:]: r for r in catalog.collect()}
    expected = {"top.txt", "a/x.md", "t.csv", "t.json", "c.yml"} | ({"pkg/__init__.py"} if hidden is not False else set())
    assert set(got) == expected
    assert (got["top.txt"]["line_count"], got["top.txt"]["language"]) == (2, "en")
    assert got["t.csv"]["column_types"] == {"p": "integer", "q": "integer"} and got["t.csv"]["row_count"] == 1
    assert got["t.json"]["json_depth"] == 2 and got["t.json"]["columns"] == ["a"]
    assert got["a/x.md"]["content_preview"] == "�� bytes"
    assert (got["t.json"]["format"], got["t.json"]["structure"], got["top.txt"]["format"]) == ("json", None, None)
    if hidden is not False:
        code = got["pkg/__init__.py"]
        assert code["imports"]["standard_library"] == ["os"] and [f["name"] for f in code["functions"]] == ["f"]


def test_refresh_index_replaces_and_keeps(spark, tree, tmp_path):
    root, _ = tree
    index = str(tmp_path / "index")
    catalog = sm.build_catalog(spark, root)
    first = sm.refresh_index(spark, catalog, index).head()
    assert (first["succeeded"], first["failed"]) == (7, 0)
    changed = catalog.where(F.endswith("path", F.lit(".txt")))
    sm.refresh_index(spark, changed, index, visible_to=["team"])
    stored = sm.read_index(spark, index)
    assert stored.count() == 7 and sm.visible_entries(stored).count() == 5
    assert sm.get_entry(stored, f"file://{root}/top.txt").head()["content"]["language"] == "en"
    assert sm.index_stats(stored).head()["index_size_bytes"] > 1000


def test_catalog_json_round_trip(spark, tree, tmp_path):
    root, _ = tree
    catalog = sm.build_catalog(spark, root)
    sm.write_catalog_json(catalog, str(tmp_path / "json"))
    back = sm.read_catalog_json(spark, str(tmp_path / "json"), catalog.schema)
    key = lambda df: sorted((r["path"], r["modified_at"], r["keywords"], str(r["file"])) for r in df.collect())
    assert key(back) == key(catalog)
    flat = sm.to_index_schema(back)
    assert len(flat.columns) == 15 and dict(flat.dtypes)["size_bytes"] == "bigint"


def test_user_profile_with_a_vectorised_function(spark, rows):
    import pandas as pd

    @F.pandas_udf("shout string")
    def shout(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shout": texts.str.upper()})

    registry = Registry()
    registry.register_extractor("shout", suffixes=[".TXT"], fn=shout)
    registry.register_extractor("shout", suffixes=[".md"])  # a second time changes nothing
    files = sm.files_from_table(rows([("/a.txt", "hi"), ("/b.md", "hi")], "path string, content string"))
    got = {r["path"]: r for r in sm.catalog_from_files(files, registry=registry, tabular=False).collect()}
    assert got["/a.txt"]["shout"] == "HI" and got["/b.md"]["shout"] is None
    assert got["/a.txt"]["profiles"] == ["text", "shout"]


def test_merge_protects_file_and_lets_later_win(spark):
    df = spark.sql(
        "SELECT named_struct('filename', 'f') file, "
        "named_struct('p', 1, 'q', CAST(NULL AS INT), 'file', named_struct('filename', 'bad', 'n', 9)) one, "
        "named_struct('p', 2, 'error', 'e') two, CAST(NULL AS STRUCT<q: INT>) three"
    )
    r = sm.merge_profiles(df, ["one", "two", "three"]).head()
    assert (r["p"], r["q"], r["file"]["filename"], r["file"]["n"]) == (2, None, "f", 9)
    assert "error" not in r.asDict()


def test_a_refresh_rewrites_touched_buckets_alone(spark, rows, tmp_path):
    from shelfmark.plans import index_store

    index = str(tmp_path / "index")
    many = rows([(f"/f{i}", i) for i in range(300)], "path string, n long")
    sm.refresh_index(spark, many, index)
    before = index_store._current(spark, index)[1]["folders"]
    assert len(before) > 40
    sm.refresh_index(spark, rows([("/f7", 70), ("/new", 1)], "path string, n long"), index)
    after = index_store._current(spark, index)[1]["folders"]
    changed = [b for b in after if before.get(b) != after[b]]
    assert 1 <= len(changed) <= 2
    stored = {r["subject"]: r["content"]["n"] for r in sm.read_index(spark, index).collect()}
    assert stored == {f"file:///f{i}": i for i in range(300)} | {"file:///f7": 70, "file:///new": 1}
    found = sm.lookup_entry(spark, index, "file:///f7")
    assert len({p.rsplit("/", 1)[0] for p in found.inputFiles()}) == 1
    assert [r["content"]["n"] for r in found.collect()] == [70]
    assert sm.lookup_entry(spark, index, "file:///none").count() == 0
    assert sm.lookup_entry(spark, str(tmp_path / "nothing"), "x") is None
    assert sm.clean_up(spark, index, keep=1) == 0  # both refreshes still hold buckets
    sm.refresh_index(spark, many, index)
    assert sm.clean_up(spark, index, keep=1) >= 1
    assert sm.read_index(spark, index).count() == 301


def test_the_second_of_two_writers_fails(spark, rows, tmp_path):
    from shelfmark.plans import index_store

    index = str(tmp_path / "index")
    one = rows([("/a", 1)], "path string, n long")
    sm.refresh_index(spark, one, index)

    def meanwhile(old, new):
        sm.refresh_index(spark, rows([("/b", 2)], "path string, n long"), index)
        return new

    with pytest.raises(index_store.ConcurrentRefreshError):
        index_store.write_buckets(spark, sm.to_entries(one), index, meanwhile)
    assert {r["subject"] for r in sm.read_index(spark, index).collect()} == {"file:///a", "file:///b"}


def test_new_fields_and_empty_refresh(spark, rows, tmp_path):
    index = str(tmp_path / "index")
    sm.refresh_index(spark, rows([], "path string, n long"), index)
    assert sm.read_index(spark, index).count() == 0
    sm.refresh_index(spark, rows([("/a", 1)], "path string, n long"), index)
    sm.refresh_index(spark, rows([("/b", 2, "x"), (None, 3, "y")], "path string, n long, more string"), index)
    got = {r["subject"]: r["content"]["more"] for r in sm.read_index(spark, index).collect()}
    assert got == {"file:///a": None, "file:///b": "x"}


def test_directories_and_contents_come_in_bounded_pieces(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"f{i:02}.bin").write_bytes(bytes([i]) * (i * 10))
    monkeypatch.setattr(files_module, "PIECE_ENTRIES", 7)
    monkeypatch.setattr(files_module, "PIECE_BYTES", 500)
    pieces = list(files_module._scan_directories(iter([pd.DataFrame({"path": [str(tmp_path), f"{tmp_path}/gone"]})])))
    assert [len(p) for p in pieces] == [7, 7, 7, 7, 7, 6]
    assert pieces[-1].iloc[-1]["read_error"] == "FileNotFoundError"
    listed = sm.scan_files(spark, str(tmp_path)).coalesce(1)
    lost = listed.where("filename = 'f03.bin'").withColumn("path", F.concat("path", F.lit(".gone")))
    read = files_module.with_bytes(listed.unionByName(lost).coalesce(1), F.col("filename") != "f05.bin").collect()
    assert len(read) == 41
    for r in read:
        i = int(r["filename"][1:3])
        if r["path"].endswith(".gone"):
            assert (r["content"], r["read_error"]) == (None, "could not be read")
        else:
            assert r["read_error"] is None
            assert r["content"] == (None if i == 5 else bytes([i]) * (i * 10))


LONG_TEXTS = {
    "plain.txt": ("The cat and the dog, and İstanbul ΟΔΟΣ. " * 400 + "zebra ΣΑΣ\r\n" * 900).encode(),
    "lines.md": "".join(f"w{i % 997} ünïcode\u3000漢字 {i}\r\n\r" for i in range(3000)).encode(),
    "tied.txt": " ".join(f"tied{i:05}" for i in range(3000)).encode(),
    "run.txt": b"x" * 20_000 + b" end " + b"y" * 9_000 + b"\tlast",
    "late.txt": b"\r" * 6_000 + "é".encode() * 5_000 + b" the end\n" + b"z" * 4_095,
    "broken.txt": (b"caf\xc3 \xe6\xbc bad\xff\xfe la casa de la \xc3\xa9l\r\n " * 500) + b"\xe6\xbc",
    "blank.txt": b" " * 9_000, "edge.txt": b"a" * 4_095 + b" " + b"b" * 4_095 + b"\n", "above.txt": b"word " * 820,
    "table.csv": b"p,q\n" + b"1,the\n" * 2_000, "rows.json": b"[" + b'{"a": 1}, ' * 1_000 + b'{"a": 2}]',
    "module.py": b"import os\n\n" + b"x = 1\n" * 2_000, "sub/short.txt": b"the short one", "sub/none.bin": b"0" * 9_000,
}


def test_long_texts_are_profiled_in_pieces(spark, tmp_path, monkeypatch):
    """Every file used to be one row, so a task held all words of a text of any size at once."""
    root = str(tmp_path)
    (tmp_path / "sub").mkdir()
    for name, data in LONG_TEXTS.items():
        (tmp_path / name).write_bytes(data)
    found = lambda **options: {
        r["path"][len(root) + 1:]: r.asDict(True) for r in sm.build_catalog(spark, root, **options).drop("accessed_at").collect()
    }
    whole = found()
    assert set(whole) == set(LONG_TEXTS)
    monkeypatch.setattr(files_module, "TEXT_BYTES", 4_096)
    assert found() == whole and list(whole["plain.txt"]["keywords"])[:2] == ["zebra", "σας"]
    kept = found(keep_profiles=True)
    assert {n: r["profile_text"]["word_count"] for n, r in kept.items()} == {n: r["word_count"] for n, r in whole.items()}
    prefix = found(max_chars=5_000, tabular=False)
    assert prefix["plain.txt"]["char_count"] == 5_000

    listed = sm.scan_files(spark, root)
    pieces = files_module.text_pieces(listed).withColumn("task", F.spark_partition_id()).collect()
    joined = {n: [] for n in LONG_TEXTS}
    for r in sorted(pieces, key=lambda r: r["piece"]):
        joined[r["path"][len(root) + 1:]].append(bytes(r["content"]))
    assert {n: b"".join(parts) for n, parts in joined.items()} == LONG_TEXTS
    assert len({r["task"] for r in pieces}) > 4
    no_blanks = ("run.txt", "late.txt", "sub/none.bin")
    assert max(len(p) for n, parts in joined.items() for p in parts if n not in no_blanks) < 4_096 + 50


def test_long_texts_that_cannot_be_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_module, "TEXT_BYTES", 4_096)
    for name in ("gone.txt", "stays.txt"):
        (tmp_path / name).write_bytes(b"the words and the rest\n" * 1_000)
    catalog = sm.build_catalog(spark, str(tmp_path))
    os.remove(tmp_path / "gone.txt")  # gone between listing and reading
    got = {r["file"]["filename"]: r for r in catalog.collect()}
    gone, stays = got["gone.txt"], got["stays.txt"]
    assert gone["read_error"] == "could not be read" and gone["file"]["size_bytes"] == 23_000
    assert [gone[n] for n in ("content_preview", "line_count", "word_count", "char_count", "language", "keywords")] == [None] * 6
    assert (stays["read_error"], stays["word_count"], stays["line_count"], stays["language"]) == (None, 5_000, 1_001, "en")
    assert stays["keywords"] == ["words", "rest"] and stays["content_preview"] == ("the words and the rest\n" * 50)[:1000]


def test_long_texts_are_not_read_whole(spark, tmp_path, monkeypatch):
    """Only files that another profile takes are rows with their whole content."""
    from shelfmark.plans import catalog as plan

    monkeypatch.setattr(files_module, "TEXT_BYTES", 4_096)
    for name in ("long.txt", "long.csv", "long.py", "long.html"):
        (tmp_path / name).write_bytes(b"a = 1, 2\n" * 1_000)
    (tmp_path / "short.txt").write_bytes(b"short")
    asked = []
    read = plan.with_bytes
    monkeypatch.setattr(plan, "with_bytes", lambda files, wanted: asked.append(files.where(wanted)) or read(files, wanted))
    assert sm.build_catalog(spark, str(tmp_path)).where("read_error IS NULL AND word_count > 0").count() == 5
    names = [sorted(r["filename"] for r in a.select("filename").collect()) for a in asked]
    assert names == [["long.py", "short.txt"], ["long.csv"]]
