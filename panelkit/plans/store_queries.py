"""Queries on what is kept between runs: models, logs, snapshots, refreshed panels;
and on exact samples, votes, dictionaries and checks of what is read and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import dictionary, model_store, panel as op, reshape, samples, scoring
from panelkit.operators.counted import JoinCounts
from panelkit.operators.keys import once
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.model_queries import FITTED, fitted
from panelkit.plans.panel_queries import COUNTY, MEANS
from panelkit.plans.registry import query
from panelkit.plans.sql import with_
from panelkit.session import shared_path, stage
from panelkit.sources import readers, writers


@query("model_store", with_(sql.FULL, FITTED, """fitted AS (SELECT state, alert_type, count(DISTINCT fips) AS n_places FROM rows
  WHERE NOT is_target AND NOT is_test AND count IS NOT NULL GROUP BY ALL)""",
       """SELECT state, alert_type, 1::BIGINT AS version, n_fit, n_test, n_places, n_predicted, n_predicted AS n_equal, 1::BIGINT AS n_versions
  FROM fits JOIN fitted USING (state, alert_type) WHERE n_fit > 0 AND n_predicted > 0"""))
def model_store_(spark, d):
    """Models saved, read back from the manifest, and used on the rows of the target year: as many predictions as rows
    have to equal those of the fit. A version that ended before its manifest is written too, and must not be seen."""
    fit, base = fitted(spark, d), shared_path(spark, "models")
    model_store.publish(fit, base)
    model_store.write_parts(fit, base)
    rows = fit.predictions.select("state", "alert_type", "fips", "date", F.col("pred_count").alias("before"))
    scored = model_store.score(rows, base)
    near = F.abs(F.col("pred_count") - F.col("before")) <= 1e-9 * (1 + F.abs("before"))
    counted = scored.groupBy("state", "alert_type").agg(F.count(F.lit(1)).alias("n_predicted"), F.count_if(near).alias("n_equal"))
    kept = model_store.best_models(spark, base).select("state", "alert_type", "version", "n_fit", "n_test", "n_places")
    return counted.join(kept, ["state", "alert_type"]).withColumn("n_versions", F.lit(len(model_store.versions(spark, base))).cast("long"))


def _hash(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || l_orderkey || '|' || l_linenumber), 1, {samples.DIGITS}))::BIGINT"


def _first(share: str, seed: int, source: str) -> str:
    return f"""row_number() OVER (PARTITION BY l_returnflag ORDER BY {_hash(seed)}, l_orderkey, l_linenumber)
  <= floor(count(*) OVER (PARTITION BY l_returnflag) * {share}) FROM {source}"""


LINE = ["l_orderkey", "l_linenumber"]


@query("exact_split", f"SELECT l_orderkey, l_linenumber, l_returnflag, NOT ({_first('0.7', samples.SEED, 'lineitem').replace(' FROM', ') AS is_test FROM')}")
def exact_split(spark, d):
    """Exactly 70 of 100 rows of each group for training, rounded down."""
    rows = data.table(spark, d, "lineitem").select(*LINE, "l_returnflag")
    return samples.exact_split(rows, ["l_returnflag"], 0.3, keys=LINE)


@query("exact_thinning", f"""WITH thin AS (SELECT *, {_first('0.2', samples.SEED + 1, 'lineitem').replace(' FROM', ' AS kept FROM')}),
thinned AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM thin WHERE kept)
SELECT *, NOT ({_first('0.7', samples.SEED, 'thinned').replace(' FROM', ') AS is_test FROM')}""")
def exact_thinning(spark, d):
    """An exact fifth of each group first, and 70 of 100 rows of that."""
    rows = data.table(spark, d, "lineitem").select(*LINE, "l_returnflag")
    return samples.exact_split(rows, ["l_returnflag"], 0.3, keys=LINE, thin=0.2)


CUTOFFS = {"1-URGENT": (0.5, 0.3, 0.2), "2-HIGH": (0.2, 0.2, 0.6), "3-MEDIUM": (0.8, 0.1, 0.1), "5-LOW": (1.0, 1.0, 1.0)}
FLAGS = ("A", "N", "R")
VOTES = """votes AS (SELECT l_orderkey, any_value(o_orderpriority) AS o_orderpriority, """ + ", ".join(
    f"count(*) FILTER (WHERE l_returnflag = '{f}') / count(*)::DOUBLE AS votes_{f}" for f in FLAGS) + """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""


def votes(spark, d) -> DataFrame:
    """The lines of an order as votes for its class."""
    lines = data.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[(F.count_if(F.col("l_returnflag") == f) / F.count(F.lit(1))).alias(f"votes_{f}") for f in FLAGS])
    orders = data.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return lines.join(orders, "l_orderkey").select("l_orderkey", "o_orderpriority", *[f"votes_{f}" for f in FLAGS])


def _winner(cuts: str) -> str:
    """Pairs of ratio and class, in descending order of the ratio and then that of the classes."""
    rows = " UNION ALL ".join(
        f"SELECT l_orderkey, {i} AS place, '{f}' AS class, votes_{f} / cut_{f} AS ratio FROM {cuts}" for i, f in enumerate(FLAGS))
    return f"""ratios AS ({rows}), won AS (SELECT l_orderkey, first(class ORDER BY ratio DESC, place) AS pred_class FROM ratios
  WHERE ratio IS NOT NULL GROUP BY l_orderkey)"""


@query("voted_class", with_(VOTES, "cut AS (SELECT *, 0.5::DOUBLE AS cut_A, 0.3::DOUBLE AS cut_N, 0.2::DOUBLE AS cut_R FROM votes)", _winner("cut"),
       "SELECT l_orderkey, pred_class FROM won"))
def voted_class(spark, d):
    return scoring.voted_class(votes(spark, d), dict(zip(FLAGS, (0.5, 0.3, 0.2)))).select("l_orderkey", "pred_class")


_CUT_ROWS = ", ".join(f"('{g}', {', '.join(f'{x}::DOUBLE' for x in c)})" for g, c in CUTOFFS.items())


@query("voted_class_by_group", with_(VOTES, f"cutoffs(o_orderpriority, cut_A, cut_N, cut_R) AS (VALUES {_CUT_ROWS})",
       "cut AS (SELECT * FROM votes LEFT JOIN cutoffs USING (o_orderpriority))", _winner("cut"),
       "SELECT o_orderpriority, pred_class, count(*) AS n FROM votes LEFT JOIN won USING (l_orderkey) GROUP BY ALL"))
def voted_class_by_group(spark, d):
    """Classes by the cut-offs of each order's group; orders of a group without cut-offs have none."""
    cuts = spark.createDataFrame([(g, f, x) for g, c in CUTOFFS.items() for f, x in zip(FLAGS, c)], "o_orderpriority string, class string, cutoff double")
    return scoring.voted_class(votes(spark, d), cuts, ["o_orderpriority"]).groupBy("o_orderpriority", "pred_class").agg(F.count(F.lit(1)).alias("n"))


@query("place_dictionary", """SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS id
  FROM (SELECT DISTINCT c_nationkey, c_name FROM customer WHERE c_name IS NOT NULL)""")
def place_dictionary(spark, d):
    """Customers of a nation numbered from 0."""
    return dictionary.dense_ids(data.table(spark, d, "customer"), ["c_nationkey"], "c_name")


@query("append_once", """SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS priority, count(*) AS n FROM orders
  WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL""")
def append_once(spark, d):
    """The reports of two years in a log, the first of them appended twice by a run that is repeated."""
    orders = data.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"))
    base = shared_path(spark, "log")
    for year in (1995, 1995, 1996):
        report = orders.where(F.col("year") == year).groupBy("year", "priority").agg(F.count(F.lit(1)).alias("n"))
        writers.append_once(report, base, f"run-{year}")
    return readers.read_log(spark, base, "year int, priority string, n long")


DELIVERABLES = {"state_day": ["state", "date"], "place_day": ["fips", "date"], "kind_day": ["alert_type", "date"], "day": ["date"], "full": ["fips", "date", "alert_type"]}


@query("published_snapshot", with_(sql.PANEL, " UNION ALL ".join(
    f"SELECT '{n}' AS name, DATE '1998-06-01' AS snapshot_date, count(*) AS n_rows, CAST(sum(total) AS BIGINT) AS total FROM "
    f"(SELECT sum(count) AS total FROM panel WHERE date < DATE '1998-06-01' GROUP BY {', '.join(k)})" for n, k in DELIVERABLES.items())))
def published_snapshot(spark, d):
    """Five deliverables published for one day. Those of the next day are written but not published, so readers stay with the day before."""
    panel, base = data.staged_panel(spark, d), shared_path(spark, "snapshots")

    def deliverables(day: str) -> dict[str, DataFrame]:
        known = panel.where(F.col("date") < F.lit(day).cast("date"))
        return {n: known.groupBy(*k).agg(F.sum("count").alias("total")) for n, k in DELIVERABLES.items()}

    writers.publish_snapshot(deliverables("1998-06-01"), base, "1998-06-01")
    writers.write_deliverables(deliverables("1998-06-02"), base, "1998-06-02")
    parts = [df.select("snapshot_date", "total").groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("total").alias("total")).select(F.lit(n).alias("name"), "snapshot_date", "n_rows", "total")
        for n, df in readers.read_published(spark, base).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LATE = ("1997-12-20", "1998-01-10")


def _late(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A panel before some days of one state came, and those days."""
    late = F.col("date").between(*[F.lit(x).cast("date") for x in LATE]) & (F.col("state") == "ASIA")
    return panel.where(~late), panel.where(late).select("date")


@query("weekly_refresh", with_(sql.PANEL, sql.weeks(COUNTY, window=data.WINDOW), "SELECT * FROM weekly"))
def weekly_refresh(spark, d):
    """A stored weekly panel brought up to date after late days around the turn of a year."""
    panel, path = data.staged_panel(spark, d), shared_path(spark, "weekly")
    early, late = _late(panel)
    first = op.weekly_panel(early, COUNTY, window=data.WINDOW)
    op.write_weekly(first, path)
    op.refresh_weekly(panel, late, path, COUNTY, window=data.WINDOW)
    return op.read_stored(first, path)


@query("daily_match_refresh", with_(sql.PANEL, sql.match(COUNTY), f"""SELECT * REPLACE ({sql.each('round(prior_mean_{k}, 6) AS prior_mean_{k}')})
  FROM matched"""))
def daily_match_refresh(spark, d):
    panel, path = data.staged_panel(spark, d), shared_path(spark, "daily")
    early, late = _late(panel)
    first = op.daily_match_panel(early, COUNTY)
    op.write_daily_match(first, path)
    op.refresh_daily_match(panel, late, path, COUNTY)
    return data.shown(op.read_stored(first, path), *MEANS)


@query("join_counts", with_(sql.DAILY, """SELECT name, n AS n_before, n AS n_after FROM (SELECT count(*) AS n FROM daily)
  CROSS JOIN (VALUES ('cases'), ('places')) j(name)"""))
def join_counts(spark, d):
    """Rows of the daily counts before and after the joins of cases and of place names, seen by the job that runs them."""
    counts = JoinCounts()
    with_cases = counts.join("cases", data.daily(spark, d), once(data.cases(spark, d), ["fips", "date"]), ["fips", "date"])
    named = counts.join("places", with_cases, once(data.places(spark, d), ["fips"]), ["fips"])
    stage(named, "joined")
    counts.check()
    return spark.createDataFrame(counts.counts(), "name string, n_before long, n_after long")


@query("malformed_rows", """SELECT CASE l_linenumber WHEN 7 THEN 'quantity: not double' WHEN 6 THEN 'shipped: not date' WHEN 5 THEN 'number of values' END AS reason,
  count(*) AS n, CAST(sum(CASE WHEN l_linenumber < 5 THEN l_quantity END) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL""")
def malformed_rows(spark, d):
    """Lines of text, some with a value of the wrong type and some a value short: good rows on one side, the others with their reason on another."""
    n, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    quantity = F.when(n == 7, "some").otherwise(F.coalesce(text("l_quantity"), F.lit("NA")))
    shipped = F.when(n == 6, "soon").otherwise(F.to_date("l_shipdate").cast("string"))
    line = F.concat_ws(",", text("l_orderkey"), quantity, F.when(n != 5, shipped))
    base = shared_path(spark, "lines")
    rows = data.table(spark, d, "lineitem").select(line.alias("value"))
    rows.write.text(f"{base}/text")
    schema = "key long, quantity double, shipped date"
    good = readers.load_csv(spark, f"{base}/text", schema, f"{base}/bad", header=False)
    bad = readers.read_table(spark, f"{base}/bad")
    kept = good.agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("long").alias("quantity"))
    side = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return side.select("reason", "n", F.lit(None).cast("long").alias("quantity")).unionByName(
        kept.select(F.lit(None).cast("string").alias("reason"), "n", "quantity"))


@query("one_hot_round_trip", with_(sql.PANEL, """seen AS (SELECT DISTINCT county FROM panel WHERE state <> 'ASIA')""",
       """SELECT p.county, s.county AS decoded, count(*) AS n, CAST(sum(p.count) AS BIGINT) AS total, (SELECT count(*) FROM seen) AS n_places
  FROM panel p LEFT JOIN seen s ON s.county = p.county GROUP BY ALL"""))
def one_hot_round_trip(spark, d):
    """Places as sparse vectors and back. Those of one state have no place of their own and come back unknown."""
    panel = data.staged_panel(spark, d)
    values = reshape.categories(panel.where("state <> 'ASIA'"), "county")
    back = reshape.from_one_hot(reshape.one_hot(panel, "county", values, "vector"), "vector", "decoded")
    return back.groupBy("county", "decoded").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).withColumn(
        "n_places", F.lit(len(reshape.one_hot_values(reshape.one_hot(panel, "county", values, "vector"), "vector"))).cast("long"))
