import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placerank.functions import geo
from placerank.operators import expansion, locality, preference, queries, ranking, reviews, skew, word2vec
from placerank.operators.skew import spread_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_spread_join_splits_hot_keys_without_changing_the_result(spark):
    rnd = random.Random(1)
    big = [(i, "hot" if i % 3 else f"k{rnd.randrange(20)}") for i in range(600)] + [(999, None)]
    many = [(j, "hot" if j % 2 else f"k{rnd.randrange(20)}") for j in range(60)]
    lookup = [(k, k.upper()) for k in ["hot"] + [f"k{i}" for i in range(10)]]
    b = spark.createDataFrame(big, "i int, key string")
    m = spark.createDataFrame(many, "j int, key string")
    one = spark.createDataFrame(lookup, "key string, name string")
    pairs = spread_join(b, m, ["key"], ["i"], ["j"], per_task=50)
    assert rows(pairs.select("i", "j")) == sorted((i, j) for i, k in big for j, l in many if k == l)
    names = dict(lookup)
    left = spread_join(b, one, ["key"], ["i"], how="left", per_task=7).select("i", "name")
    assert sorted(left.collect(), key=lambda r: r.i) == sorted((i, names.get(k)) for i, k in big)


def test_spread_join_splits_any_number_of_hot_keys(spark):
    """Three thousand keys are all over the limit, and every one is cut into parts."""
    b = spark.range(3000 * 12).selectExpr("id as i", "id % 3000 as key")
    m = spark.range(3000 * 3).selectExpr("id as j", "id % 3000 as key")
    hot = skew.hot_keys(skew.key_counts(b, ["key"]), skew.key_counts(m, ["key"]), ["key"], 9)
    assert hot.filter("_big_part * _small_part >= 4").count() == 3000
    pairs = spread_join(b, m, ["key"], ["i"], ["j"], per_task=9)
    plain = b.join(m, "key")
    total = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("i", "j").cast("decimal(38,0)"))).first())
    assert total(pairs) == total(plain) and total(plain)[0] == 3000 * 36


@pytest.mark.parametrize("rows_, groups, per_task", [(1500, 30, 20000), (300, 2, 4000)])
def test_spread_join_deals_out_pairs_of_few_bytes(spark, rows_, groups, per_task):
    """Adaptive execution would put rows of a few kilobytes into one task, with all their pairs."""
    b = spark.range(rows_).selectExpr("id as i", f"id % {groups} as key")
    m = spark.range(rows_).selectExpr("id as j", f"id % {groups} as key")
    pairs = spread_join(b, m, ["key"], ["i"], ["j"], per_task=per_task)
    held = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(held) == rows_ * rows_ // groups and max(held) <= sum(held) / 5


def test_spread_join_keeps_pairs_apart_if_its_first_side_could_be_broadcast(spark):
    """The side that is dealt out is the lesser one, and the other is one task's."""
    b = spark.range(200).selectExpr("id as i", "id % 20 as key").coalesce(1)
    m = spark.range(3000).selectExpr("id as j", "id % 20 as key").coalesce(1)
    pairs = spread_join(b, m, ["key"], ["i"], ["j"], per_task=20000)
    held = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(held) == 200 * 150 and max(held) <= sum(held) / 4


def test_spread_join_cuts_many_rows_of_the_held_side(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 30)
    b = spark.createDataFrame([(i, i % 3) for i in range(6)], "i long, key long")
    m = spark.createDataFrame([(j, j % 2 * 2) for j in range(150)], "j long, key long")
    counts = skew.key_counts(b, ["key"]), skew.key_counts(m, ["key"])
    assert rows(skew.hot_keys(*counts, ["key"], 10**6)) == [(0, 3, 1), (2, 3, 1)]
    pairs = spread_join(b, m, ["key"], ["i"], ["j"])
    assert rows(pairs.select("i", "j")) == rows(b.join(m, "key").select("i", "j")) and pairs.count() == 300


def test_radial_join_equals_brute_force(spark):
    """With repeated and missing ids, points and radii, over the date line and the poles, in one task or many."""
    rng = random.Random(8)
    points = [(rng.choice([27.0, 89.5, -89.9, 10.0]) + rng.uniform(-.4, .4), rng.choice([-82.0, 179.9, -179.9]) + rng.uniform(-.2, .2)) for _ in range(150)]
    points = [(f"b{i}", None, None, min(a, 90.0), (o + 180) % 360 - 180) for i, (a, o) in enumerate(points)]
    points += points[:5] + [(None, *points[0][1:]), ("x", None, None, None, 1.0), ("y", None, None, 1.0, None)]
    circles = [(f"q{i}", "Radial", None, None, *rng.choice(points[:150])[3:], rng.choice([0.0, 3.0, 20.0, 60.0, 5000.0, 25000.0])) for i in range(40)]
    circles += circles[:3] + [(None, *circles[0][1:]), ("n", "radial", None, None, 27.0, -82.0, None), ("s", "state", "S1", None, 27.0, -82.0, 20.0)]
    asked = spark.createDataFrame(circles, "query_id string, locality_mode string, state string, city string, latitude double, longitude double, radius_km double")
    where = spark.createDataFrame(points, "business_id string, state string, city string, latitude float, longitude double")
    distance = geo.haversine(F.col("b.latitude"), F.col("b.longitude"), F.col("q.latitude"), F.col("q.longitude"))
    plain = asked.alias("q").crossJoin(where.alias("b")).filter("lower(locality_mode) = 'radial' and b.latitude + b.longitude is not null").filter(distance <= F.col("radius_km")).select(
        "query_id", "business_id", distance.alias("distance_km"))
    true = sorted(map(repr, plain.collect()))
    assert len(true) > 1000
    for per_task in (None, 40):
        assert sorted(map(repr, locality.radial_join(asked, where, per_task=per_task).collect())) == true


def brute_bins(values):
    bins = pd.qcut(pd.Series(values), max(int(math.sqrt(len(values))), 1), duplicates="drop", labels=False)
    return bins.fillna(0).astype(int).tolist()


@pytest.mark.parametrize("per_task", [None, 5])
def test_bins_equal_pandas(spark, per_task):
    rnd, data = random.Random(7), []
    sizes = [1, 2, 3, 4, 5, 9, 10, 16, 17, 33, 50, 101]
    for q, n in enumerate(sizes):
        data += [(f"a{q}", f"b{i}", round(rnd.random() * 4, 12), 1.0) for i in range(n)]
        data += [(f"t{q}", f"b{i}", rnd.randrange(4) / 4, 1.0) for i in range(n)]
    data += [("same", f"b{i}", 0.5, 1.0) for i in range(9)]
    df = spark.createDataFrame(data, "query_id string, business_id string, similarity double, quality double")
    found = ranking.similarity_bins(df, per_task=per_task).select("query_id", "business_id", "similarity_bin").toPandas()
    found = found.set_index(["query_id", "business_id"])["similarity_bin"]
    for q, group in pd.DataFrame(data).groupby(0):
        assert [found[q, b] for b in group[1]] == brute_bins(group[2].tolist()), q


def test_top_n_in_slices_equals_sort(spark):
    rnd = random.Random(3)
    data = [("q", f"b{i}", rnd.random(), float(rnd.randrange(5)), 4) for i in range(200)]
    df = spark.createDataFrame(data, "query_id string, business_id string, similarity double, quality double, n int")
    binned = ranking.similarity_bins(df)
    want = [r.business_id for r in ranking.top_n_single(binned, 4).collect()]
    sliced = ranking.top_n(binned, rows_per_task=20).orderBy("rank").collect()
    assert [r.business_id for r in sliced] == want and [r["rank"] for r in sliced] == [1, 2, 3, 4]


def test_latest_stars(spark):
    df = spark.createDataFrame([
        ("u", "b", 5.0, "2020-12-16 00:00:00", "r1"), ("u", "b", 1.5, "2021-02-14 00:00:00", "r2"),
        ("u", "c", 2.0, "2021-02-14 00:00:00", "r3"), ("u", "c", 3.0, "2021-02-14 00:00:00", "r4"),
    ], "user_id string, business_id string, stars double, date string, review_id string")
    assert rows(preference.latest_stars(df)) == [("u", "b", 1.5), ("u", "c", 3.0)]


def test_impute_and_preference(spark):
    a, b = [None] * 23, [0] * 23
    a[12], b[12], b[0] = 4, 2, 1
    pool = spark.createDataFrame([("q", "x", a, 4.0), ("q", "y", b, 0.0)],
                                 "query_id string, business_id string, attrs array<tinyint>, user_stars double")
    means = preference.impute_means(pool, ["query_id"]).first().means
    assert means[0] == 1 and means[12] == 3 and means[11] == 0
    lonely = preference.impute_means(pool.filter("business_id = 'x'"), ["query_id"]).first().means
    assert lonely[3] == 1 and lonely[11] == 1 and lonely[0] == 0
    vectors = preference.business_vectors(pool, ["query_id"])
    taste = preference.preference_vectors(vectors, ["query_id"]).first().preference
    assert np.isclose(np.linalg.norm(taste), 1)
    none = preference.preference_vectors(vectors.filter("user_stars = 0"), ["query_id"]).first().preference
    assert none is None


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0] * 23, [0.0] * 23)], "attrs array<tinyint>, means array<double>")
    mean = preference.mean_vectors(preference.unit_vectors(df.withColumn("g", F.lit(1))), ["g"]).first().preference
    assert mean == [0.0] * 23


def test_nearest_words_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = {f"w{i}": rng.normal(size=6) for i in range(40)}
    df = spark.createDataFrame([(w, v.tolist()) for w, v in words.items()], "word string, vector array<double>")
    block = expansion.ROWS_PER_BLOCK
    expansion.ROWS_PER_BLOCK = 7
    try:
        found = expansion.nearest_words(df.select(F.col("word").alias("term"), F.lit(3).alias("k")), df).collect()
    finally:
        expansion.ROWS_PER_BLOCK = block
    for term, v in words.items():
        score = {w: v @ u / np.linalg.norm(v) / np.linalg.norm(u) for w, u in words.items() if w != term}
        assert [r.word for r in sorted((r for r in found if r.term == term), key=lambda r: r["rank"])] == sorted(
            score, key=lambda w: -score[w])[:3]


def test_locality_errors(spark):
    df = spark.createDataFrame([("b", "S", "C", 1.0, 1.0)], "business_id string, state string, city string, latitude double, longitude double")
    for bad in [("state",), ("radial", [1.0, 1.0], 3), ("radial", (1.0, 1.0)), ("planet", "x")]:
        with pytest.raises(ValueError):
            locality.in_locality(df, bad)
    assert locality.in_locality(df, ("RADIAL", (1.0, 1.0), 0)).count() == 1


def test_areas_hold_their_circles(spark):
    """Each point in a circle is dealt to the circle's area, also over the date line and the poles."""
    import random

    import numpy as np

    from placerank.functions import geo

    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    circles = [(*rng.choice([(0.0, 179.9), (89.5, 10.0), (-89.9, -170.0), (27.9, -82.4), (60.0, -179.99)]), 10 ** rng.uniform(0, 4.4)) for _ in range(60)]
    points += [(min(max(a + rng.uniform(-1, 1), -90.0), 90.0), (o + rng.uniform(-1, 1) + 180) % 360 - 180) for a, o, _ in circles]
    asked = spark.createDataFrame([("radial", None, None, *c) for c in circles], "locality_mode string, state string, city string, latitude double, longitude double, radius_km double")
    areas = [r[0] for r in asked.select(locality.query_area()).collect()]
    where = spark.createDataFrame([(i, None, None, *p) for i, p in enumerate(points)], "i int, state string, city string, latitude double, longitude double")
    rows = locality.area_rows(where, asked.withColumn("area", locality.query_area())).select("i", "area").collect()
    dealt = {tuple(r) for r in rows}
    assert len(dealt) == len(rows)
    order = sorted(range(len(points)), key=lambda i: points[i][0])
    lat, lon = (np.array([points[i][k] for i in order]) for k in (0, 1))
    inside = 0
    for (a, o, r), area in zip(circles, areas):
        true = {order[j] for j in np.flatnonzero(geo._distance(lat, a, o - lon) <= r)}
        assert {order[j] for j in geo.circle_rows(lat, lon, np.arange(len(order)), a, o, r)} == true
        assert all((i, area) in dealt for i in true)
        inside += len(true)
    assert inside > 500


def test_drop_reviewed_with_ratings_brought_along(spark):
    """The same candidates as by a join with the ratings, without a shuffle of the candidates."""
    asked = spark.createDataFrame([("q", "u", "c"), ("r", None, "c"), ("s", "v", "d"), ("t", "u", "d")], "query_id string, user_id string, city string")
    df = spark.createDataFrame([("1", "c"), ("2", "c"), (None, "c"), ("1", "d"), ("3", "d"), ("3", "d")], "business_id string, city string")
    rated = spark.createDataFrame([("u", "1", "c"), ("u", "1", "d"), ("v", "3", "d"), (None, "2", "c"), ("v", None, "c")], "user_id string, business_id string, city string")
    plain = preference.drop_reviewed(asked.join(df, "city"), rated).select("query_id", "business_id")
    candidates = preference.with_reviewed(asked, rated, ["user_id", "city"]).join(df, "city")
    found = preference.drop_reviewed(candidates).select("query_id", "business_id")
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: tuple(map(str, r))
    assert sorted(found.collect(), key=key) == sorted(plain.collect(), key=key) and found.count() == 8


def test_requests(spark):
    bodies = [("1", "u", "{}"), ("2", "u", '{"categories": [" Bars ", ""], "n": "x"}'), ("3", "u", '{"locality_mode": "moon"}')]
    df = queries.normalize_requests(spark.createDataFrame(bodies, "query_id string, user_id string, body string"))
    first = df.filter("query_id = 1").first()
    assert (first.categories, first.scope, first.n, first.time_minutes, first.radius_km) == (["Bars", "Nightlife"], 5, 5, 1260, 5.0)
    good, bad = queries.split_queries(df)
    assert [r.query_id for r in good.collect()] == ["1"]
    assert {r.query_id: r.reason for r in bad.collect()} == {"2": "invalid number", "3": "unknown locality mode"}


def test_review_edits(spark):
    schema = "review_id string, user_id string, stars double, text string, useful int, funny int, cool int, date string"
    old = spark.createDataFrame([("a", "u", 1.0, "x", 0, 0, 0, "d"), ("b", "u", 2.0, "y", 0, 0, 0, "d")], schema)
    patch = spark.createDataFrame([("a", "4.5", None), ("z", "1", "n")], "review_id string, stars string, text string")
    assert rows(reviews.patch_reviews(old, patch).select("review_id", "stars", "text")) == [("a", 4.5, "x"), ("b", 2.0, "y")]
    assert rows(reviews.unknown_ids(patch, old)) == [("z",)]
    assert rows(reviews.delete_reviews(old, patch).select("review_id")) == [("b",)]
    new = spark.createDataFrame([("u", "3", "hi")], "user_id string, stars string, text string")
    added = reviews.append_reviews(old, new, "2024-01-01 00:00:00").filter("text = 'hi'").first()
    assert (added.stars, added.useful, added.date) == (3.0, 0, "2024-01-01 00:00:00") and added.review_id.startswith("r-")
    stars = spark.createDataFrame([(0.0,), (4.5,), (4.3,), (5.5,), (None,)], "stars double")
    assert reviews.split_by_stars(stars)[0].count() == 2


def test_document_vectors_keep_zeros(spark):
    docs = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["none"]), ("c", []), ("d", None)], "key string, words array<string>")
    known = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [4.0, -1.0])], "word string, vector array<double>")
    found = {r.key: r.vector for r in expansion.document_vectors(docs, "key", "words", known).collect()}
    assert found == {"a": [2.0, 1.0], "b": [0.0, 0.0], "c": [0.0, 0.0], "d": [0.0, 0.0]}


def test_document_vectors_shuffle_a_row_for_each_document(spark):
    """Rows between the lookup and the result do not grow with the dimensions."""
    docs = spark.range(300).selectExpr("concat('d', id) as key", "array('x', 'y', concat('u', id % 3)) as words")
    known = spark.createDataFrame([("x", [float(i) for i in range(40)]), ("y", [0.5] * 40)], "word string, vector array<double>")
    found = expansion.document_vectors(docs, "key", "words", known)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    assert found.filter("vector[3] = 3.5D / 3 and size(vector) = 40").count() == 300
    odd = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), (None, ["x"])], "key string, words array<string>")
    short = spark.createDataFrame([("x", [1.0]), ("z", [1.0, 2.0])], "word string, vector array<double>")
    assert {r.key: r.vector for r in expansion.document_vectors(odd, "key", "words", short).collect()} == {"a": [2.0], None: [0.0, 0.0]}


def test_nearest_words_of_a_block_with_ties_and_small_k(monkeypatch):
    """Many terms of one block at once: ties by word, a term's own word left out, k up to all words; one frame for all."""
    rnd = np.random.default_rng(3)
    grid = rnd.integers(-1, 2, (60, 3)).astype(float)
    names = [f"w{(7 * i) % 60:02d}" for i in range(60)]
    words = pd.DataFrame({"word": names, "vector": list(grid)})
    terms = pd.DataFrame({"term": [*names[:20], "other"], "term_vector": [*grid[:20], grid[0]], "k": [1, 3, 59, 70, 2] * 4 + [60]})
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(expansion.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    found = expansion._block_neighbours(terms, words)
    monkeypatch.undo()
    assert len(made) == 1
    lengths = np.linalg.norm(grid, axis=1)
    units = np.divide(grid, lengths[:, None], out=np.zeros_like(grid), where=lengths[:, None] > 0)
    expected = []
    for term, vector, k in zip(terms["term"], units[[*range(20), 0]], terms["k"]):
        near = sorted((-round(float(c), 9), w) for w, c in zip(names, units @ vector) if w != term)[:k]
        expected += [(term, w, -c, k) for c, w in near]
    assert [(t, w, k) for t, w, _, k in found.itertuples(index=False)] == [(t, w, k) for t, w, _, k in expected]
    assert np.allclose(found["cosine"], [c for _, _, c, _ in expected], atol=2e-9)


def test_base_key_collisions_deals_customers_out(spark, tmp_path, monkeypatch):
    """A file of few bytes becomes several tasks before its rows grow; ids may repeat or be null."""
    from checks import registry

    monkeypatch.setattr(registry, "CUSTOMERS_PER_TASK", 10)
    ids = [(i,) for i in range(35)] + [(3,), (None,)]
    spark.createDataFrame(ids, "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["base_key_collisions"](spark, str(tmp_path))
    assert "hashpartitioning(c_custkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    assert sorted(((r.c_custkey, r["keys"]) for r in found.collect()), key=str) == sorted([*((i, 18) for i in range(35)), (None, 18)], key=str)


def test_base_key_collisions_tells_kinds_of_places_apart(spark, tmp_path, monkeypatch):
    """Of three lists, two users and three kinds of places each has its own key; a key that forgets the kind would show."""
    from checks import registry

    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert registry.QUERIES["base_key_collisions"](spark, str(tmp_path)).first()["keys"] == 18
    digest = registry.requests._digest
    forgetful = lambda: digest(F.col("user_id"), F.col("categories"), F.coalesce("state", "city"))
    monkeypatch.setattr(registry.requests, "base_key", forgetful)
    assert registry.QUERIES["base_key_collisions"](spark, str(tmp_path)).first()["keys"] == 12


def test_rewrite_json_stages_a_compact_copy(spark, tmp_path):
    from placerank import sources

    path = f"{tmp_path}/rows"
    df = spark.range(3000).selectExpr("id", "repeat('long text ', 20) as text", "cast(null as string) as gap")
    df.write.json(path)
    with sources.temporary_tables(spark):
        staged = []
        real = sources.shared.shared_path
        sources.shared.shared_path = lambda *a: staged.append(real(*a)) or staged[-1]
        try:
            sources.rewrite_json(spark.read.schema(df.schema).json(path).withColumn("id", F.col("id") + 1), path)
        finally:
            sources.shared.shared_path = real
        bytes_of = lambda d: sum(os.path.getsize(f"{d}/{f}") for f in os.listdir(d))
        assert len(staged) == 1 and bytes_of(staged[0]) * 5 < bytes_of(path)
    assert spark.read.schema(df.schema).json(path).agg(F.sum("id"), F.count("text"), F.count("gap")).first()[:] == (3000 * 3001 // 2, 3000, 0)


def test_scope_zero_starts_no_search(spark):
    words = spark.createDataFrame([("x", [1.0])], "word string, vector array<double>")
    terms = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "query_id int, term string, scope int")
    found = expansion.expand_terms(terms, words)
    assert sorted(r.matched for r in found.collect()) == ["x", "y"]
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_word2vec_trains_in_several_tasks(spark):
    lists = spark.createDataFrame([(["a", "b", "c"],)] * 60, "categories array<string>").repartition(3)
    assert word2vec.fit(lists, minCount=1, vectorSize=4).getNumPartitions() == 3


def test_temporary_tables_are_removed(spark):
    from placerank import sources

    with sources.temporary_tables(spark):
        kept = sources.materialize(spark.range(3).toDF("a"), "kept")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)


def test_suggestions_for_requests_equal_single_ones(spark):
    words = ["Bars", "Beer Bar", "barbers", "Café", "B", "Ba", "Sushi Bars", "Éclair", "aaa", "aab", "baab"]
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    texts = ["bar", " BAR ", "b", "a", "aa", "aab", "caf", "é", "xyz", "", "  ", None, "sushi bars", "sushi barsx"]
    asked = [(f"q{i}", t, s) for i, (t, s) in enumerate((t, s) for t in texts for s in (None, [], ["Bars", "aab"]))]
    table = spark.createDataFrame(asked, "query_id string, text string, selected array<string>")
    got = {}
    for r in expansion.suggest_for_requests(vocabulary, table, 3, per_task=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.word))
    for q, t, chosen in asked:
        want = [r.word for r in expansion.suggest_categories(vocabulary, t or "", chosen or [], 3).collect()]
        assert [w for _, w in sorted(got.get(q, []))] == want


def test_curve_layout_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from placerank import sources
    from placerank.functions import geo

    rnd = random.Random(2)
    points = [(f"b{i}", rnd.uniform(25, 45), rnd.uniform(-120, -70)) for i in range(8000)] + [("none", None, None)]
    df = spark.createDataFrame(points, "business_id string, latitude double, longitude double").repartition(2)
    curve = geo.curve_position(F.col("latitude"), F.col("longitude"))
    box = lambda lo, hi, a, b: lo <= b and a <= hi
    met = {}
    for name, order in (("plain", ["business_id"]), ("curve", [curve])):
        spark.conf.set("parquet.block.size", "16384")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        try:
            sources.write_if_absent(df, str(tmp_path / name), order)
        finally:
            spark.conf.unset("parquet.block.size")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        groups = [g for f in (tmp_path / name).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
        stats = [(g.column(1).statistics, g.column(2).statistics) for g in groups if g.column(1).statistics.has_min_max]
        met[name] = sum(box(27.0, 29.0, la.min, la.max) and box(-84.0, -81.0, lo.min, lo.max) for la, lo in stats), len(stats)
        again = spark.read.parquet(str(tmp_path / name))
        assert again.count() == 8001
        assert rows(locality.in_radius(again, 28.0, -82.5, 100)) == rows(locality.in_radius(df, 28.0, -82.5, 100))
    assert met["plain"][0] == met["plain"][1] >= 8 and met["curve"][0] <= met["curve"][1] // 4


def _area(rows, tile=2048):
    """An area of (id, quality, hours, attrs, categories, latitude, longitude)."""
    import pyarrow as pa

    from placerank.operators import blocks

    kind = pa.struct([("business_id", pa.string()), ("quality", pa.float64()), ("hours", pa.list_(pa.int32())), ("attrs", pa.list_(pa.int8())),
                      ("categories", pa.list_(pa.string())), ("latitude", pa.float32()), ("longitude", pa.float32())])
    names = [f.name for f in kind]
    batches = [pa.RecordBatch.from_pydict({
        "area": ["a"], "tile": [0], "tiles": [1], "size": [len(rows)],
        "rows": pa.array([[dict(zip(names, r)) for r in rows[lo:lo + tile]]], pa.list_(kind))}) for lo in range(0, len(rows), tile)]
    return blocks.Area([b.column("rows")[0].as_py() for b in blocks._squeeze(batches)])


def _some_rows(n, seed=5):
    rnd = np.random.default_rng(seed)

    def maybe(x):
        return None if rnd.random() < 0.2 else int(x)

    return [(f"b{rnd.integers(n)}", maybe(rnd.integers(5)), [maybe(x) for x in rnd.integers(0, 1440, 14)], [maybe(x) for x in rnd.integers(0, 4, 23)],
             [str(w) for w in rnd.choice(["x", "y", "z", "x"], rnd.integers(0, 4))] + [None] * (i % 7 == 0), float(rnd.integers(9)), float(rnd.integers(9)))
            for i in range(n)]


def test_scores_of_many_readers_are_those_of_each():
    """One product for all readers of a pool gives every score to the last bit, also where the grid's steps are near, and it is one."""
    from placerank.operators import blocks

    rows = _some_rows(900)
    area = _area(rows, 100)
    rnd = np.random.default_rng(6)
    block = blocks.Block(area, area.matching(["x", "y", "gone"], None, None, None), rnd.random(23))
    exact = np.eye(23)[:5] * 0.5
    tastes = np.concatenate([rnd.random((300, 23)) / 5, exact, np.zeros((1, 23)), np.full((1, 23), np.nan), 1e-12 * rnd.random((40, 23)), 40 * exact])
    expected, calls = np.array([block.similarity(t) for t in tastes]), []
    block.similarity = lambda *a: calls.append(a)
    found = block.similarities(tastes)
    assert np.array_equal(found.view(np.int64), expected.view(np.int64)) and not calls


def test_area_and_places_agree_with_rows():
    """Blocks read one by one: categories, attributes, hours and repeated ids are those of the rows."""
    from placerank.operators import blocks

    rows = _some_rows(300)
    area = _area(rows, 64)
    order = sorted(range(len(rows)), key=lambda i: rows[i][5])
    assert area.ids.to_pylist() == [rows[i][0] for i in order] and area.quality.to_pylist() == [rows[i][1] for i in order]
    for terms in (["x"], ["y", "z"], [], ["gone"]):
        assert area.matching(terms, None, None, None).tolist() == [k for k, i in enumerate(order) if set(terms) & set(rows[i][4])]
    own = np.arange(0, 300, 2)
    block = blocks.Block(area, own, np.full(23, 0.25))
    assert block.filled.T.tolist() == [[0.25 if a is None else a for a in rows[order[k]][3]] for k in own]
    for day, minutes in ((-1, -1), (0, 0), (3, 700), (6, 1439)):
        def opened(hours):
            def at(d):
                return hours[2 * d:2 * d + 2]
            o, c = at(day) if day >= 0 else (None, None)
            p, q = at((day + 6) % 7)
            today = o is not None and o <= minutes and c is not None and (c > minutes or c <= o)
            return today or p is not None and q is not None and q <= p and q > minutes
        assert block.open_at(day, minutes).tolist() == [opened(rows[order[k]][2]) for k in own]
    import pyarrow as pa

    names = [rows[order[k]][0] for k in own]
    lists = [[names[4], "gone", names[9]], None, [], [names[0]]]
    last = {n: i for i, n in enumerate(names)}
    assert [p.tolist() for p in block.places(pa.array(lists, pa.list_(pa.string())))] == [[last[n] for n in some or [] if n in last] for some in lists]


def test_only_bins_near_the_top_are_worked_out():
    from placerank.operators import blocks

    rnd = np.random.default_rng(8)
    for k in range(200):
        values = rnd.integers(0, rnd.integers(1, 60), rnd.integers(1, 400)) / 8
        if k % 10 == 0:
            values[rnd.integers(len(values))] = np.nan
        ordered = np.sort(values)
        edges = np.unique(ordered[::max(1, int(np.sqrt(len(values))))])
        bins = np.maximum(np.searchsorted(edges, values, "left"), 1) - 1
        for n in (1, 5, len(values), 1000):
            for known in (ordered, None):
                near, own = blocks._near(values, edges, n, known)
                assert own.tolist() == bins[near].tolist()
                nth = np.sort(bins)[max(0, len(bins) - n)]
                assert set(np.flatnonzero(bins >= nth)) <= set(near.tolist())
        assert len(blocks._near(np.arange(10_000.0), np.arange(0, 10_000, 100.0), 5, None)[0]) <= 100
