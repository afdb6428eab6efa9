from __future__ import annotations

from datetime import date

import pytest

from conftest import rows
from panelkit.session import shared_folder, stage
from panelkit.sources import readers, schemas, writers


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "out")


def test_leading_nulls_keep_their_type(spark, base):
    df = spark.createDataFrame([(None, "a"), (2.5, "b")], "x double, s string")
    writers.write_csv(df, base)
    back = readers.read_csv(spark, base, schemas.with_types(["x", "s"], x="double"), null_value="")
    assert back.dtypes == [("x", "double"), ("s", "string")] and rows(back) == rows(df)


def test_delimited_monthly_table(spark, tmp_path):
    path = tmp_path / "series.csv"
    months = ";".join(f"m{i}" for i in range(12))
    path.write_text(f"y;t;{months}\n2019;tax;" + ";".join(str(i) for i in range(11)) + ";...\n")
    r = readers.read_delimited(spark, str(path), schemas.monthly_wide_schema()).first()
    assert (r.Year, r.Type, r.Jan, r.Nov, r.Dec) == (2019, "tax", 0, 10, None)


def test_footer_and_names(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("CBSA Code,CSA/Title\n10100,Aberdeen\n10140,\nNA,Note: source\n")
    df = readers.read_reference(spark, str(path), "`CBSA Code` string, `CSA/Title` string", "CBSA_Code")
    assert rows(df) == [("10100", "Aberdeen"), ("10140", None)]


def test_report_log_appends(spark, base):
    df = spark.createDataFrame([(1, 'say "hi", you')], "n int, s string")
    writers.append_log(df, base)
    writers.append_log(df, base)
    back = spark.read.schema("n int, s string").option("escape", '"').csv(base)
    assert rows(back) == [(1, 'say "hi", you')] * 2


def test_snapshots(spark, base):
    for day, n in (("2020-06-11", 1), ("2020-06-18", 2), ("2020-06-11", 3)):
        writers.write_snapshot(spark.createDataFrame([(n,)], "n int"), base, "week", day)
    assert rows(readers.read_snapshot(spark, base, "week")) == [(2, date(2020, 6, 18))]
    assert rows(readers.read_snapshot(spark, base, "week", "2020-06-11")) == [(3, date(2020, 6, 11))]


def test_up_to_leaves_out_late_days(spark):
    df = spark.createDataFrame([(date(2020, 5, d),) for d in (1, 7, 8)], "date date")
    assert rows(readers.up_to(df, "2020-05-10", 3)) == [(date(2020, 5, 1),), (date(2020, 5, 7),)]


def test_stage_uses_the_shared_folder(spark):
    staged = stage(spark.range(10).toDF("n"), "numbers", partition_by=())
    assert staged.count() == 10
    assert all(shared_folder(spark) in f.removeprefix("file:").replace("file://", "") for f in staged.inputFiles())


def test_hot_partition_values_are_split_and_small_ones_are_not(spark, base):
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "20KB")
    try:
        df = spark.range(40000).repartition(8).selectExpr(
            "CASE WHEN id < 39000 THEN 'hot' ELSE 'cold' END AS state", "'JAM' AS alert_type", "id")
        writers.write_predictions(df, base)
    finally:
        spark.conf.set(setting, before)
    back = readers.read_table(spark, base)
    assert back.count() == 40000
    states = ["hot" if "state=hot" in f else "cold" for f in back.inputFiles()]
    assert states.count("hot") > 3 and states.count("cold") == 1


class _Session:
    """The parts of a session that the choice of the shared folder reads."""

    def __init__(self, master, setting=None, checkpoints=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"
        self.getCheckpointDir = lambda: checkpoints


def test_shared_folder_is_the_setting_then_the_contexts_own_then_local_only():
    from panelkit.session import shared_folder

    assert shared_folder(_Session("yarn", "hdfs://x/ck/", "hdfs://y")) == "hdfs://x/ck"
    assert shared_folder(_Session("yarn", None, "hdfs://y")) == "hdfs://y"
    assert "panelkit-" in shared_folder(_Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session("spark://host:1"))


def test_clear_staged_removes_what_was_written(spark):
    import os

    from panelkit.session import clear_staged, shared_path, stage

    assert stage(spark.range(3)).count() == 3
    path = shared_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(path)
    clear_staged(spark)
    assert not os.path.isdir(path)
