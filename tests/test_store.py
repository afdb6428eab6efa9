"""What is kept between runs, exact samples, votes, dictionaries, and checks of reads and joins."""

from __future__ import annotations

from collections import Counter
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from panelkit.operators import dictionary, expected, model_store, panel as op, reshape, samples, scoring
from panelkit.operators.counted import JoinCounts
from panelkit.session import stage
from panelkit.sources import ledger, readers, writers

FOREST = {"numTrees": 4, "minInstancesPerNode": 5, "maxDepth": 5}


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "kept")


@pytest.fixture(scope="module")
def counts(spark):
    """Three places in two states with a level each and a weekday effect, from 2018 to February 2020."""
    days = spark.sql("SELECT explode(sequence(DATE'2018-01-01', DATE'2020-02-29')) AS date")
    place = F.explode(F.array(*[F.struct(F.lit(f).alias("fips"), F.lit(s).alias("state"), F.lit(level).alias("level"))
                                for f, s, level in (("01", "A", 10), ("02", "A", 100), ("03", "B", 50))]))
    count = F.col("level") + F.when(F.dayofweek("date").isin(1, 7), 0).otherwise(F.col("level"))
    df = days.select("date", place.alias("p")).select("date", "p.*")
    return stage(df.select("fips", "state", F.lit("JAM").alias("alert_type"), "date", count.cast("long").alias("count")))


@pytest.fixture(scope="module")
def fit(counts):
    return expected.fit_expected(counts, 2020, forest=FOREST)


# Model store


def test_models_from_a_store_predict_what_the_fit_predicts(spark, fit, base):
    assert model_store.publish(fit, base) == 1
    before = fit.predictions.select("state", "alert_type", "fips", "date", F.col("pred_count").alias("before"))
    again = model_store.score(before, base)
    assert again.count() == before.count() == 180
    assert again.where("pred_count IS NULL OR abs(pred_count - before) > 1e-9").count() == 0
    kept = {r.state: r for r in model_store.manifest(spark, base).collect()}
    assert kept["A"].n_places == 2 and kept["B"].n_places == 1 and kept["A"].error > 0 and kept["A"].n_fit > kept["A"].n_test > 0


def test_a_version_counts_from_its_manifest_on(spark, fit, base):
    model_store.write_parts(fit, base)  # ends before the manifest
    assert model_store.versions(spark, base) == []
    rows_ = fit.predictions.select("state", "alert_type", "fips", "date")
    assert model_store.score(rows_, base).where("pred_count IS NOT NULL").count() == 0
    model_store.publish(fit, base)
    model_store.write_parts(fit, base)
    assert model_store.versions(spark, base) == [1]
    model_store.publish(fit, base)
    assert model_store.versions(spark, base) == [1, 2]
    assert {r.version for r in model_store.best_models(spark, base).collect()} == {2}
    assert {r.version for r in model_store.best_models(spark, base, version=1).collect()} == {1}
    with pytest.raises(ValueError, match="not published"):
        model_store.score(rows_, base, version=3)


def test_new_groups_and_places(spark, fit, base):
    model_store.publish(fit, base)
    day = date(2020, 3, 2)
    new = spark.createDataFrame([("A", "JAM", "99", day), ("A", "JAM", None, day), ("Z", "JAM", "01", day), (None, "JAM", "01", day)],
                                "state string, alert_type string, fips string, date date")
    found = {(r.state, r.fips): r.pred_count for r in model_store.score(new, base).collect()}
    assert found["Z", "01"] is None and found[None, "01"] is None
    assert found["A", "99"] == found["A", None] and 10 <= found["A", "99"] <= 200


def test_fit_with_tables_of_its_own_for_test_and_prediction(counts):
    early, late = counts.where("date < '2019-07-01'"), counts.where("date >= '2019-07-01' AND date < '2020-01-01'")
    ahead = counts.where("date >= '2020-02-01'").withColumn("count", F.lit(None).cast("long"))
    own = expected.fit_expected(early, 2020, forest=FOREST, test_rows=late, pred_rows=ahead)
    assert own.holdout.count() == late.count() and own.predictions.count() == ahead.count() == 87
    assert own.predictions.where("pred_count IS NULL").count() == 0
    sizes = {r.state: (r.n_fit, r.n_test) for r in own.training_sizes.collect()}
    assert sizes == {"A": (1092, 368), "B": (546, 184)}
    with pytest.raises(ValueError, match="either"):
        expected.fit_expected(early, 2020, test_rows=late, test=F.lit(True))


def test_fit_sizes_are_exact(counts):
    own = expected.fit_expected(counts, 2020, forest=FOREST, thin=0.5)
    sizes = {r.state: (r.n_fit, r.n_test) for r in own.training_sizes.collect()}
    assert sizes == {"A": (511, 219), "B": (255, 110)}


def test_class_forests_by_group(counts):
    classes = counts.withColumn("count", (F.dayofweek("date").isin(1, 7)).cast("long"))
    own = expected.fit_expected(classes, 2020, forest=FOREST, classes=True)
    votes = scoring.votes_of(own.predictions, ["0", "1"])
    named = scoring.voted_class(votes, {"0": 0.8, "1": 0.2})
    report = {(r.state, r["count"], r.pred_class): r.n for r in scoring.class_report(named, "count", "pred_class", ["state"]).collect()}
    assert report == {("A", 0, "0"): 86, ("A", 1, "1"): 34, ("B", 0, "0"): 43, ("B", 1, "1"): 17}


def test_usual_number_of_features():
    assert expected.forest_settings({})["featureSubsetStrategy"] == "1"
    assert expected.forest_settings({}, 9)["featureSubsetStrategy"] == "3" and expected.forest_settings({}, 2)["featureSubsetStrategy"] == "1"
    assert expected.forest_settings({}, 10, classes=True)["featureSubsetStrategy"] == "3"
    assert expected.forest_settings({"featureSubsetStrategy": "8"})["featureSubsetStrategy"] == "8"


# Exact samples


def test_samples_have_exact_sizes(spark):
    df = spark.range(10_007).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g", "id % 50 AS v")
    out = samples.exact_split(df, ["g"], 0.3)
    sizes = {r.g: (r.n, r.t) for r in out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {g: (n, n - n * 7 // 10) for g, n in ((None, 3336), (1, 3336), (2, 3335))}
    assert out.columns == ["id", "g", "v", "is_test"] and out.select("id").distinct().count() == 10_007
    again = samples.exact_split(df.repartition(7), ["g"], 0.3)
    assert rows(again.where("is_test").select("id")) == rows(out.where("is_test").select("id"))
    assert samples.exact_split(df.limit(0), ["g"], 0.3).collect() == []


@pytest.mark.parametrize("size", [0, 1, 499, 500, 501, 700, 5000])
def test_ties_are_cut_exactly(spark, size):
    """A third of the rows is one row repeated, and many rows share a key but differ in another column."""
    df = spark.range(1500).selectExpr("CASE WHEN id < 500 THEN 'hot' WHEN id < 1000 THEN 'shared' ELSE string(id) END AS k",
                                      "CASE WHEN id < 500 THEN 0 ELSE id END AS v")
    out = samples.choose(df, [], F.lit(size), keys=["k"])
    assert out.count() == 1500 and out.where("chosen").count() == min(size, 1500)
    assert Counter(tuple(r)[:2] for r in out.collect()) == Counter(tuple(r) for r in df.collect())


def test_only_a_slice_of_the_hashes_is_ranked(spark, monkeypatch):
    """Frequencies of single hashes stay a small part of the rows, and the first rows by the hash are chosen."""
    ranked = []

    def seen(df, name="stage", partition_by=()):
        out = stage(df, name, partition_by)
        if name == "frequencies":
            ranked.append(out.count())
        return out

    monkeypatch.setattr(samples, "stage", seen)
    df = spark.range(20_000).selectExpr("id", "id % 2 AS g")
    out = samples.choose(df, ["g"], F.lit(3_000)).withColumn("h", samples.key_hash(["id", "g"])).collect()
    assert ranked and sum(ranked) < 200
    for g in (0, 1):
        own = sorted((r.h, r.chosen) for r in out if r.g == g)
        assert [chosen for _, chosen in own] == [True] * 3_000 + [False] * 7_000


def test_copies_come_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(samples, "COPIES", 7)
    out = samples.choose(spark.range(100).selectExpr("'x' AS k"), [], F.lit(33))
    assert Counter(r.chosen for r in out.collect()) == {True: 33, False: 67}


def test_reserved_names_are_an_error(spark):
    with pytest.raises(ValueError, match="_hash"):
        samples.choose(spark.range(1).withColumn("_hash", F.lit(1)), [], F.lit(1))


# Votes


def test_ties_and_missing_votes(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.2, 0.8), (3, None, 0.1), (4, None, None), (5, 0.0, 0.0)], "id int, votes_a double, votes_b double")
    found = lambda cuts: {r.id: r.pred_class for r in scoring.voted_class(df, cuts).collect()}
    assert found({"a": 0.5, "b": 0.5}) == {1: "a", 2: "b", 3: "b", 4: None, 5: "a"}
    assert found({"b": 0.5, "a": 0.5})[1] == "b" and found({"a": 0.1, "b": 0.9}) == {1: "a", 2: "a", 3: "b", 4: None, 5: "a"}
    with pytest.raises(ValueError, match="above 0"):
        scoring.voted_class(df, {"a": 0.0, "b": 1.0})


def test_cutoffs_by_group(spark):
    df = spark.createDataFrame([("x", 0.4, 0.6), ("y", 0.4, 0.6), (None, 0.4, 0.6), ("z", 0.4, 0.6)], "g string, votes_a double, votes_b double")
    cuts = [("x", "a", 0.1), ("x", "b", 0.9), ("y", "a", 0.5), ("y", "b", 0.5), (None, "a", 0.3), (None, "b", 0.7)]
    table = spark.createDataFrame(cuts, "g string, class string, cutoff double")
    assert {r.g: r.pred_class for r in scoring.voted_class(df, table, ["g"]).collect()} == {"x": "a", "y": "b", None: "a", "z": None}
    for more in (("x", "a", 0.2), ("w", "a", 0.0)):
        wrong = table.unionByName(spark.createDataFrame([more], table.schema))
        with pytest.raises(PySparkException):
            scoring.voted_class(df, wrong, ["g"]).collect()


# Dictionary and one-hot


def test_a_million_places_get_dense_numbers(spark):
    df = spark.range(1_000_000).selectExpr("CASE WHEN id % 10 < 7 THEN 'big' ELSE 'small' END AS g", "concat('place-', id) AS p")
    ids = dictionary.dense_ids(df.unionByName(df.limit(1000)), ["g"], "p")
    found = {r.g: tuple(r)[1:] for r in ids.groupBy("g").agg(F.count(F.lit(1)), F.countDistinct("id"), F.min("id"), F.max("id")).collect()}
    assert found == {"big": (700_000, 700_000, 0, 699_999), "small": (300_000, 300_000, 0, 299_999)}
    back = dictionary.decode(dictionary.encode(df.limit(100), ids, ["g"], "p", "n").drop("p"), ids, ["g"], "n", "p")
    assert rows(back.select("g", "p")) == rows(df.limit(100))


def test_numbers_follow_the_order_of_values(spark):
    df = spark.createDataFrame([("b", None), ("b", "y"), ("b", "x"), ("b", "x"), (None, "z"), (None, "a")], "g string, p string")
    assert rows(dictionary.dense_ids(df, ["g"], "p")) == [(None, "a", 0), (None, "z", 1), ("b", "x", 0), ("b", "y", 1)]
    assert rows(dictionary.dense_ids(df, [], "p")) == [("a", 0), ("x", 1), ("y", 2), ("z", 3)]
    ids = dictionary.dense_ids(df, ["g"], "p")
    new = spark.createDataFrame([("b", "new"), ("b", None), ("c", "x")], "g string, p string")
    assert {r.n for r in dictionary.encode(new, ids, ["g"], "p", "n").collect()} == {None}


def test_one_hot_and_back(spark, base):
    df = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "place string")
    hot = reshape.one_hot(df, "place", ["a", "b"], "vector")
    assert hot.columns == ["place", "vector"] and reshape.one_hot_values(hot, "vector") == ["a", "b"]
    assert all(r.vector.size == 3 and len(r.vector.indices) == 1 for r in hot.collect())
    hot.write.parquet(base)  # names of places stay with the column
    back = reshape.from_one_hot(spark.read.parquet(base), "vector", "again")
    assert {r.place: r.again for r in back.collect()} == {"a": "a", "b": "b", "new": None, None: None}
    assert reshape.categories(df, "place") == ["a", "b", "new"]
    with pytest.raises(ValueError, match="more than 2"):
        reshape.categories(df, "place", 2)


# Logs and snapshots


def test_a_repeated_run_adds_nothing(spark, base):
    df = spark.createDataFrame([(1, 'say "hi", you')], "n int, s string")
    assert writers.append_once(df, base, "r1") and not writers.append_once(df, base, "r1")
    assert writers.append_once(df.withColumn("n", F.lit(2)), base, "r2")
    assert rows(readers.read_log(spark, base, "n int, s string")) == [(1, 'say "hi", you'), (2, 'say "hi", you')]


def test_a_run_that_ended_before_its_commit_can_be_repeated(spark, base):
    df = spark.createDataFrame([(1,)], "n int")
    writers.append_log(df, ledger.fresh_path(base, "rows"))
    assert readers.read_log(spark, base, "n int").collect() == []
    with pytest.raises(PySparkException):
        writers.append_once(df.withColumn("n", F.raise_error(F.lit("no")).cast("int")), base, "r1")
    assert writers.append_once(df, base, "r1") and rows(readers.read_log(spark, base, "n int")) == [(1,)]


def test_of_two_commits_of_a_run_the_first_counts(spark, base):
    for n in (1, 2):
        path = ledger.fresh_path(base, "rows")
        writers.append_log(spark.createDataFrame([(n,)], "n int"), path)
        ledger.commit(spark.createDataFrame([("r", path)], writers.RUN), base)
    assert rows(readers.read_log(spark, base, "n int")) == [(1,)]


def test_readers_see_all_deliverables_of_a_day_or_those_before(spark, base):
    frames = lambda n: {name: spark.createDataFrame([(n,)], "n int") for name in "abcde"}
    with pytest.raises(ValueError, match="nothing is published"):
        readers.read_published(spark, base)
    writers.publish_snapshot(frames(1), base, "2020-06-11")
    broken = frames(2) | {"e": spark.range(1).select(F.raise_error(F.lit("stop")).cast("int").alias("n"))}
    for day in ("2020-06-18", "2020-06-11"):
        with pytest.raises(PySparkException, match="stop"):
            writers.publish_snapshot(broken, base, day)
        found = readers.read_published(spark, base)
        assert sorted(found) == list("abcde") and all(rows(df) == [(1, date(2020, 6, 11))] for df in found.values())
    writers.publish_snapshot(frames(3), base, "2020-06-11")
    assert rows(readers.read_published(spark, base, "2020-06-11")["c"]) == [(3, date(2020, 6, 11))]
    writers.publish_snapshot(frames(4), base, "2020-06-25")
    assert rows(readers.read_published(spark, base)["a"]) == [(4, date(2020, 6, 25))]
    assert {r.snapshot_date for r in readers.published(spark, base).collect()} == {date(2020, 6, 11), date(2020, 6, 25)}


# Refresh


def _panel(spark, last="2020-03-31"):
    days = spark.sql(f"SELECT explode(sequence(DATE'2018-01-01', DATE'{last}')) AS date")
    return stage(days.selectExpr("date", "explode(array('a', 'b')) AS place").selectExpr(
        "place", "date", "'JAM' AS alert_type", "pmod(hash(place, date), 50) AS count"))


@pytest.mark.parametrize("late", [("2020-03-01", "2020-03-09"), ("2018-12-28", "2019-01-03"), ("2018-01-01", "2018-01-01"), ("2019-02-05", "2019-02-06")])
@pytest.mark.parametrize("window", [None, ("2019-02-03", "2019-02-23")])
def test_refreshed_panels_equal_full_ones(spark, base, late, window):
    panel = _panel(spark)
    is_late = F.col("date").between(*[F.lit(d).cast("date") for d in late]) & (F.col("place") == "a")
    for full, write, refresh, more in (
        (op.weekly_panel, op.write_weekly, op.refresh_weekly, {"window": window}), (op.daily_match_panel, op.write_daily_match, op.refresh_daily_match, {}),
    ):
        path = f"{base}/{full.__name__}"
        first = full(panel.where(~is_late), ["place"], **more)
        write(first, path)
        assert rows(op.read_stored(first, path)) != rows(full(panel, ["place"], **more))
        refresh(panel, panel.where(is_late), path, ["place"], **more)
        assert rows(op.read_stored(first, path)) == rows(full(panel, ["place"], **more))


def test_a_refresh_leaves_other_weeks_alone(spark, base):
    import os

    panel = _panel(spark)
    op.write_weekly(op.weekly_panel(panel, ["place"]), base)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}
    before = files()
    op.refresh_weekly(panel, spark.sql("SELECT DATE'2019-05-15' AS date"), base, ["place"])
    changed = {f.split("/year=")[1].rsplit("/", 1)[0] for f in before - files()}
    assert changed == {"2019/week=20", "2019/week=21", "2020/week=20"} & {f.split("/year=")[1].rsplit("/", 1)[0] for f in before}


# Checks of joins and of what is read


@pytest.mark.parametrize("right, how, fails", [
    ([(1, "x"), (2, "y")], "left", None), ([(1, "x")], "left", None), ([(1, "x"), (1, "y")], "left", "repeated"), ([(1, "x")], "inner", "lost"),
])
def test_joins_are_counted_as_they_run(spark, base, right, how, fails):
    counts = JoinCounts()
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    counts.join("names", left, spark.createDataFrame(right, "k int, v string"), ["k"], how).write.parquet(base)
    (name, before, after), = counts.counts()
    assert (name, before) == ("names", 3)
    if fails:
        with pytest.raises(ValueError, match=fails):
            counts.check()
    else:
        counts.check()
        assert after == 3


def test_malformed_rows_go_aside_with_their_reason(spark, base, tmp_path):
    (tmp_path / "in.csv").write_text('n,x,d\n1,1.5,2020-01-01\nNA,NA,NA\none,1,2020-01-01\n2,"a, b",2020-01-01\n3,1,someday\n4,1\n5,1,2020-01-01,more\n')
    good = readers.load_csv(spark, str(tmp_path / "in.csv"), "n int, x double, d date", base)
    assert rows(good) == [(None, None, None), (1, 1.5, date(2020, 1, 1))]
    bad = {r.record: r.reason for r in readers.read_table(spark, base).collect()}
    assert bad == {"one,1,2020-01-01": "n: not int", '2,"a, b",2020-01-01': "x: not double", "3,1,someday": "d: not date",
                   "4,1": "number of values", "5,1,2020-01-01,more": "number of values"}
    with pytest.raises(ValueError, match="_reason"):
        readers.checked_csv(spark, str(tmp_path / "in.csv"), "n int, _reason string")


def test_a_repeated_place_is_an_error(spark):
    panel = spark.createDataFrame([("01", 1)], "fips string, n int")
    names = spark.createDataFrame([("01", "a"), ("01", "b")], "fips string, county string")
    assert rows(op.attach_dimension(panel, names.limit(1))) == [("01", 1, names.first().county)]
    with pytest.raises(PySparkException, match="repeated key"):
        op.attach_dimension(panel, names).collect()
