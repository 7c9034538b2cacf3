import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from placerank import sources
from placerank.plans import Query, batch, recommend_batch, single

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: sources.materialize(getattr(fx, name)(spark, SF), name) for name in ("business", "review", "queries")}


def test_batch_equals_single_and_does_not_depend_on_splitting(spark, tables):
    business, review, queries = tables["business"], tables["review"], tables["queries"]
    some = queries.filter(F.col("query_id").isin("q3", "q20"))
    whole = recommend_batch(some, business, review)[0].collect()
    split = recommend_batch(some, business, review, per_task=3)[0].collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split)) and whole
    for q in some.collect():
        where = {
            "radial": ("radial", (q.latitude, q.longitude), q.radius_km), "city": ("city", q.city), "state": ("state", q.state),
        }[q.locality_mode.lower()]
        alone = single.rank(
            business, review, Query(q.user_id, where, q.categories, q.day, q.time_minutes), q.n,
            q.currently_open, q.recommend_reviewed).collect()
        mine = sorted((r for r in whole if r.query_id == q.query_id), key=lambda r: r["rank"])
        assert [(r.business_id, r.similarity_bin) for r in alone] == [(r.business_id, r.similarity_bin) for r in mine]


def test_unknown_category_and_scope_are_rejected(spark, tables):
    vocabulary = spark.createDataFrame([("red",)], "word string")
    asked = tables["queries"].filter(F.col("query_id").isin("q1", "q2", "q4")).withColumns({
        "categories": F.when(F.col("query_id") == "q1", F.array(F.lit("red"), F.lit("nowhere"))).otherwise(F.array(F.lit("red"))),
        "scope": F.when(F.col("query_id") == "q2", 3).otherwise(0)})
    good, bad = batch.resolve_queries(asked, vocabulary, None)
    assert [r.query_id for r in good.collect()] == ["q4"]
    assert {r.query_id: r.reason for r in bad.collect()} == {"q1": "unknown category", "q2": "no word vectors for scope"}
    with pytest.raises(ValueError):
        single.similar_categories(vocabulary, ["nowhere"], 0, None)


def test_scan_gets_filters_and_columns(tables):
    plan = single.locality.in_state(tables["business"], "S1").filter("is_open").select("business_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,S1)" in text and "name:string" not in text.split("ReadSchema")[-1]


def test_pool_store_keeps_pools_between_calls(spark, tables, monkeypatch):
    from placerank.sources import PoolStore, shared_path, table_version

    review = tables["review"]
    business = sources.materialize(tables["business"], "business")
    some = tables["queries"].filter(F.col("query_id").isin("q3", "q20", "q33", "q40"))
    more = tables["queries"].filter(F.col("query_id").isin("q3", "q20", "q33", "q40", "q51", "q62"))
    path = shared_path(spark, "store")

    def answers(asked, table, **how):
        return sorted(map(tuple, recommend_batch(asked, table, review, min_count=1, **how)[0].collect()))

    want = answers(some, business)
    store = PoolStore.of(business, path)
    assert want and answers(some, business, pool_store=store) == want
    held = {r.pool_id for r in store.known().collect()}
    computed, plain = [], batch.pool_tables

    def counted(resolved, *rest):
        computed.extend(r.pool_id for r in resolved.select("pool_id").distinct().collect())
        return plain(resolved, *rest)

    monkeypatch.setattr(batch, "pool_tables", counted)
    assert answers(some, business, pool_store=PoolStore.of(business, path)) == want and computed == []
    wider = answers(more, business, pool_store=store)
    assert computed and not held & set(computed)
    assert wider == answers(more, business)
    # What a stopped call left behind does not count, what two calls added at once counts once.
    tastes, packs = store.read(spark.createDataFrame([(i,) for i in held], "pool_id string"))
    store.add(tastes, packs)
    packs.withColumn("batch", F.lit("stopped")).withColumn("bucket", F.lit(0)).write.parquet(f"{store.root}/blocks-stopped")
    packs.limit(0).write.parquet(f"{store.root}/pools-stopped")
    (marker,) = [f"{store.root}/pools-stopped/_SUCCESS"]
    where = spark._jvm.org.apache.hadoop.fs.Path(marker)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    assert "stopped" not in store.batches() and answers(some, business, pool_store=store) == want
    # Other businesses are another version.
    fewer = sources.materialize(business.filter("business_id > 'b15'"), "business")
    assert table_version(fewer) != table_version(business) == table_version(business.select("*"))
    assert table_version(business.filter("is_open")) != table_version(business)
    assert answers(some, fewer, pool_store=PoolStore.of(fewer, path)) == answers(some, fewer)
    with pytest.raises(ValueError):
        table_version(spark.createDataFrame([(1,)], "a int"))
    store.forget()
    assert store.batches() == []


def test_blocks_do_not_change_results(spark, tables, monkeypatch):
    """Pools in many blocks, readers in many tiles and scores in many cells give the rows of one block."""
    from placerank.operators import blocks

    business, review, queries = tables["business"], tables["review"], tables["queries"]
    some = queries.filter("locality_mode <> 'city'").limit(12)
    want = sorted(map(tuple, recommend_batch(some, business, review, min_count=1)[0].collect()))
    monkeypatch.setattr(blocks, "READER_TILE", 1)
    monkeypatch.setattr(blocks, "CELL_ROWS", 2)
    pack = blocks.pack_blocks
    monkeypatch.setattr(blocks, "pack_blocks", lambda found: pack(found, 3))
    got = sorted(map(tuple, recommend_batch(some, business, review, min_count=1)[0].collect()))
    assert got == want and len({r[0] for r in got}) > 3


def test_areas_in_parts_do_not_change_results(spark, tables, monkeypatch):
    """Areas cut into parts, whose bins come from merged histograms, give the rows of whole ones."""
    from placerank.operators import blocks

    business, review, queries = tables["business"], tables["review"], tables["queries"]
    some = queries.filter("locality_mode <> 'city'").limit(8)
    want = sorted(map(tuple, recommend_batch(some, business, review, min_count=1)[0].collect()))
    monkeypatch.setattr(blocks, "WHOLE_ROWS", 15)
    monkeypatch.setattr(blocks, "CELL_ROWS", 20)
    monkeypatch.setattr(blocks, "TILE", 4)
    pack = blocks.pack_blocks
    monkeypatch.setattr(blocks, "pack_blocks", lambda found: pack(found, 4))
    assert want and sorted(map(tuple, recommend_batch(some, business, review, min_count=1)[0].collect())) == want


def test_blocks_grow_with_businesses_not_with_pools(spark, tables):
    """Pools of one state share its blocks, however many they are."""
    asked = tables["queries"].filter("locality_mode = 'state' and state = 'S2'")
    resolved = batch.resolve_queries(asked, tables["business"].selectExpr("explode(categories) as word").distinct(), None)[0]
    tastes, packs = batch.pool_tables(sources.materialize(resolved, "resolved"), batch.pack_business(tables["business"]))
    assert tastes.where("neutral is not null").count() > 3
    open_ = tables["business"].filter("is_open and state = 'S2' and categories is not null").count()
    assert packs.dropDuplicates(["area"]).selectExpr("sum(size)").first()[0] == open_


def test_review_book_equals_whole_table_edits(spark, tmp_path):
    import random

    from placerank.operators import preference, reviews as edits
    from placerank.plans.review_book import ReviewBook

    rng = random.Random(5)
    schema = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, text string, date string"
    first = [(f"r{i}", f"u{rng.randrange(6)}", f"b{rng.randrange(5)}", rng.randrange(10) / 2, 0, 0, 0, "t", f"2020-01-{rng.randint(1, 28):02d} 00:00:00")
             for i in range(120)]
    first += [("r-null", "u1", "b1", None, 0, 0, 0, None, None), ("r-pair", None, "b1", 3.0, 0, 0, 0, "t", "2020-02-01 00:00:00")]
    whole = spark.createDataFrame(first, schema)
    book = ReviewBook(spark, f"file://{tmp_path}/book", buckets=16)

    def same(version=None):
        key = lambda r: tuple(map(str, r))
        assert sorted(book.reviews(version).select(*whole.columns).collect(), key=key) == sorted(whole.collect(), key=key)
        assert sorted(book.latest_stars(version).collect(), key=key) == sorted(preference.latest_stars(whole).collect(), key=key)

    assert book.create(whole) == 1
    same()
    latest = preference.latest_stars(whole)
    # The latest review of some pairs, and others.
    top = [r.review_id for r in whole.groupBy("user_id", "business_id").agg(F.max_by("review_id", F.struct("date", "review_id")).alias("review_id")).collect()]
    steps = [
        ("append", spark.createDataFrame([("u1", "b1", "4.5", "new"), ("u9", "b9", "2", "new"), ("u9", "b9", "2", "new")],
                                         "user_id string, business_id string, stars string, text string")),
        ("patch", spark.createDataFrame([(top[0], "0.5", None), ("r7", "1.5", "edited"), ("gone", "1", "x")], "review_id string, stars string, text string")),
        ("patch", spark.createDataFrame([(top[1], "2019-01-01 00:00:00"), ("r9", "2030-01-01 00:00:00")], "review_id string, date string")),
        ("delete", spark.createDataFrame([(top[2],), (top[3],), ("r11",), ("gone",)], "review_id string")),
        ("delete", whole.where("user_id = 'u2'").select("review_id")),
    ]
    for n, (kind, change) in enumerate(steps, 2):
        before = book.store.manifest()
        if kind == "append":
            book.append(change, "2024-01-01 00:00:00")
            whole = edits.append_reviews(whole, change, "2024-01-01 00:00:00")
        else:
            getattr(book, kind)(change)
            whole = (edits.patch_reviews if kind == "patch" else edits.delete_reviews)(whole, change)
        whole = spark.createDataFrame(whole.collect(), schema)
        same()
        after = book.store.manifest()
        assert book.store.version() == n
        if n < 6:
            untouched = [k for k, v in before["reviews"]["buckets"].items() if after["reviews"]["buckets"].get(k) == v]
            assert len(untouched) >= 8
    # A run that stops before its manifest changes nothing; a writer that comes late is refused.
    commit = book.store.commit
    book.store.commit = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        book.delete(whole.select("review_id"))
    book.store.commit = commit
    same()
    with pytest.raises(RuntimeError):
        commit(book.store.version() - 1, {}, {})
    assert book.store.vacuum(1) and book.store.vacuum(1) == []
    same()
    assert latest.count() > 0



def test_rated_in_pools_keeps_a_rating_one_row(spark):
    """Ratings are not multiplied by their categories before the join; each pair comes once."""
    asked = spark.createDataFrame([("u", "p", ["a", "b"]), ("u", "q", ["c"]), ("v", "p", ["a", "b"]), (None, "p", ["a"])], "user_id string, pool_key string, terms array<string>")
    rated = spark.createDataFrame(
        [("u", "1", ["a", "b", "a"], 4.0, [1]), ("u", "2", ["z", None], 3.0, [2]), ("u", "3", None, 1.0, [3]), ("v", "1", ["b", "c"], 2.0, [1]), (None, "1", ["a"], 2.0, [1])],
        "user_id string, business_id string, categories array<string>, user_stars double, attrs array<tinyint>")
    found = batch.rated_in_pools(asked, rated)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.user_id, r.pool_key, r.business_id, r.user_stars) for r in found.collect()) == [("u", "p", "1", 4.0), ("v", "p", "1", 2.0)]


def test_stored_tables_and_edits_leave_nothing_behind(spark, tmp_path, monkeypatch):
    """A stored table's shuffle files go when it is written, an edit's intermediate tables when it is done; the setting is as before."""
    import os
    import time

    from placerank import sources
    from placerank.plans import review_book

    def files():
        names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {names.apply(i).getName() for i in range(names.size()) if names.apply(i).getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert sources.materialize(spark.range(500).groupBy((F.col("id") % 7).alias("k")).count(), "t").count() == 7
    stored = spark.range(500).groupBy((F.col("id") % 9).alias("k")).count()
    before |= files()
    sources.materialize(stored, "t")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    made = []
    real = review_book.materialize
    monkeypatch.setattr(review_book, "materialize", lambda df, name: made.append(real(df, name)) or made[-1])
    rows = spark.createDataFrame([(f"r{i}", f"u{i % 3}", f"b{i % 4}", float(i % 5), 0, "t", f"2020-01-{i + 1:02d}") for i in range(12)],
                                 "review_id string, user_id string, business_id string, stars double, useful int, text string, date string")
    book = review_book.ReviewBook(spark, f"{tmp_path}/book", buckets=2)
    book.create(rows)
    paths = []
    for edit in (lambda: book.patch(spark.createDataFrame([("r11", "1.0")], "review_id string, stars string")),
                 lambda: book.delete(rows.where("review_id = 'r10'")),
                 lambda: book.append(spark.createDataFrame([("u9", "b9", "2.0")], "user_id string, business_id string, stars string"), "2021-01-01")):
        edit()
        paths += [f for df in made for f in df._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location().rootPaths().mkString().split("file:")[1:]]
        made.clear()
    assert paths and not any(os.path.exists(p) for p in paths)
    assert book.reviews().count() == 12 and {r.user_stars for r in book.latest_stars().where("user_id = 'u2' and business_id = 'b3'").collect()} == {1.0}
