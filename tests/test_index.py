"""Publishing, index upkeep and search, also with hot keys."""

import pytest
from pyspark.sql import functions as F

import shelfmark as sm


def entries(rows, pairs):
    return rows([(s, v) for s, v in pairs], "subject string, v int")


def as_dict(df):
    collected = df.collect()
    assert len({r["subject"] for r in collected}) == len(collected)
    return {r["subject"]: r["v"] for r in collected}


def test_upsert_is_idempotent_and_reversible(rows):
    old, new = entries(rows, [("a", 1), ("b", 1)]), entries(rows, [("b", 2), ("c", 2)])
    once = sm.upsert_entries(old, new)
    assert as_dict(once) == {"a": 1, "b": 2, "c": 2}
    assert as_dict(sm.upsert_entries(once, new)) == as_dict(once)
    assert as_dict(sm.delete_entries(once, new)) == {"a": 1}


def test_upsert_with_a_hot_key(spark):
    hot = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("subject"),
        F.col("id").cast("int").alias("v"),
    )
    got = as_dict(sm.upsert_entries(spark.createDataFrame([("hot", -1), ("old", -1)], "subject string, v int"), hot, order_by=["v"]))
    assert got["hot"] == 89_997 and got["old"] == -1 and len(got) == 60_002


def test_ties_are_settled_the_same_way_every_time(rows):
    copies = entries(rows, [("a", i) for i in range(20)])
    picked = {as_dict(sm.latest_per_key(copies.repartition(n), "subject"))["a"] for n in (1, 3, 7)}
    assert len(picked) == 1


def test_batches_are_full_and_complete(spark):
    batched = sm.batch_entries(spark.range(1000).select(F.concat(F.lit("s"), "id").alias("subject")), n=30, buckets=4)
    sizes = [r["count"] for r in batched.groupBy("bucket", "batch_no").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) == 30 and sum(s < 30 for s in sizes) <= 4


def test_visibility_defaults_to_public(rows):
    catalog = rows([("/a", ["x"]), ("/b", []), ("/c", None)], "path string, who array<string>")
    listed = {r["subject"]: r["visible_to"] for r in sm.to_entries(catalog, visible_to=F.col("who")).collect()}
    assert listed == {"file:///a": ["x"], "file:///b": ["public"], "file:///c": ["public"]}
    published = sm.to_entries(catalog, visible_to=["team"])
    assert sm.visible_entries(published).count() == 0 and sm.visible_entries(published, ["team"]).count() == 3


def test_facets_add_up_and_ties_are_ordered(rows):
    df = rows(
        [("en", ["x", "y"]), ("en", ["y", "y"]), ("fr", []), (None, None), ("de", ["z"])],
        "language string, keywords array<string>",
    )
    got = [(r["facet"], r["value"], r["n"]) for r in sm.term_facets(df, ["language", "keywords"]).orderBy("facet", F.desc("n"), "value").collect()]
    assert got == [
        ("keywords", "y", 2), ("keywords", "x", 1), ("keywords", "z", 1), ("language", "en", 2), ("language", "de", 1), ("language", "fr", 1),
    ]
    assert sm.term_facets(df, {"L": "language"}, size=1).collect()[0]["value"] == "en"


def test_top_k_is_cut_before_the_shuffle(rows):
    df = rows([("a", "x")], "g string, v string")
    for plan in (sm.dominant_values(df, "g", "v"), sm.term_facets(df, ["g", "v"])):
        assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_dominant_values_with_a_hot_group(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
        F.floor(F.sqrt(F.col("id") % 100)).alias("v"),
    )
    top = sm.dominant_values(df, "g", "v", k=2).where("g = 'hot'").orderBy("rank").collect()
    counts = {}
    for i in range(0, 30_000, 3):
        counts[int((i % 100) ** 0.5)] = counts.get(int((i % 100) ** 0.5), 0) + 1
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [(r["v"], r["n"], r["percentage"]) for r in top] == [(v, n, round(n / 100, 2)) for v, n in expected]


def test_paging_is_stable_and_checked(spark):
    df = spark.range(25)
    pages = [[r["id"] for r in sm.page_results(df, ["id"], 10, p).collect()] for p in (1, 2, 3, 4)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]
    with pytest.raises(ValueError):
        sm.page_results(df, ["id"], 10, 0)


def test_filters(rows):
    df = rows([("a", ["x"], "2024-01-01"), ("b", ["y"], "2024-02-01")], "k string, t array<string>, d string").withColumn("d", F.to_timestamp("d"))
    assert sm.filter_terms(df, "t", ["y", "q"]).head()["k"] == "b"
    assert sm.filter_terms(df, "k", []).count() == 2
    assert sm.filter_date_range(df, "d", end="2024-01-01").head()["k"] == "a"


def test_views_and_sizes(rows):
    from shelfmark.operators.search import human_size

    sizes = rows([(0,), (1023,), (1024,), (1536,), (5 * 1024**3,)], "n bigint").select(human_size(F.col("n")).alias("s"))
    assert [r["s"] for r in sizes.collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB"]


def test_pages_flags_and_arrays(rows):
    pages = rows([("d", i, f"p{i}", i == 3) for i in range(7)] + [("e", 0, "only", False)], "doc string, no int, text string, flag boolean")
    joined = {r["doc"]: r["text"] for r in sm.join_first_pages(pages, "doc", "no").collect()}
    assert joined == {"d": "p0\n\np1\n\np2\n\np3\n\np4\n\n", "e": "only\n\n"}
    flags = {r["doc"]: r["any_page"] for r in sm.any_in_first_pages(pages, "doc", "no", "flag").collect()}
    assert flags == {"d": False, "e": False}
    long = rows([("d", 0, "w" * 10_001)], "doc string, no int, text string")
    assert sm.page_text_stats(long, "doc", "no").head()["text_preview"].endswith("w...")
    arrays = rows([([1.0, 3.0],), ([],), (None,), ([0.0] * 1000,)], "a array<double>")
    got = [(r["min"], r["max"], r["mean"], r["std"]) for r in sm.array_statistics(arrays, "a", max_len=1000).collect()]
    assert got == [(1.0, 3.0, 2.0, 1.0)] + [(None,) * 4] * 3
    assert sm.array_statistics(arrays, "a").where("size(a) = 1000").head()["max"] == 0.0


def test_hierarchy_limits(rows):
    paths = [f"/g/leaf{i:02d}" for i in range(15)] + ["/g/sub/x", "/g/sub/deep/er/y", "/top"]
    got = sm.list_hierarchy(rows([(p,) for p in paths], "path string"), max_depth=2, per_group=10).collect()
    groups = {r["item"]: r["num_items"] for r in got if r["type"] == "group"}
    leaves = [r["item"] for r in got if r["type"] == "dataset"]
    assert groups == {"g": 16, "g/sub": 2, "g/sub/deep": 1}
    assert sorted(leaves) == [f"g/leaf{i:02d}" for i in range(10)] + ["g/sub/x", "top"]


def test_buckets_follow_the_number_of_entries(spark):
    subjects = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("subject"))
    batched = sm.batch_entries(subjects, n=30, rows_per_bucket=100)
    assert batched.select("bucket").distinct().count() == 10
    assert sm.batch_entries(subjects.limit(0)).count() == 0


def test_dense_batches_leave_one_short(spark):
    subjects = spark.range(1003).select(F.concat(F.lit("s"), "id").alias("subject"), F.lit(1).alias("bucket"))
    subjects = subjects.union(spark.createDataFrame([(None, 2)] * 2, "subject string, bucket int"))
    batched = sm.number_batches(subjects, n=30, rows_per_bucket=100)
    assert batched.columns == ["subject", "bucket", "batch_no"]
    sizes = {r["batch_no"]: r["count"] for r in batched.groupBy("batch_no").count().collect()}
    assert sizes == {i: 30 for i in range(33)} | {33: 15}
    assert {r["batch_no"] for r in batched.where("subject is null").collect()} == {33}
    again = sm.number_batches(subjects.repartition(5), n=30, rows_per_bucket=100)
    assert sorted(map(str, again.collect())) == sorted(map(str, batched.collect()))
    assert sm.number_batches(subjects.limit(0)).count() == 0
