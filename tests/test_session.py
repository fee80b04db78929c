from forumlens import session


class Conf(dict):
    pass


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), Context(master)


def test_the_named_folder_is_used():
    named = Session("spark://host:7077", **{"spark.checkpoint.dir": "s3://bucket/run/"})
    assert session.shared_dir(named) == "s3://bucket/run"


def test_otherwise_a_folder_beside_the_tables():
    unset = Session("spark://host:7077", **{"spark.sql.warehouse.dir": "hdfs://tables/"})
    assert session.shared_dir(unset) == "hdfs://tables/forumlens-staging"


def test_dropping_what_was_staged(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    session.stage(spark.range(3))
    assert len(list((tmp_path / "staged").rglob("*.parquet"))) > 0
    session.drop_staged(spark)
    assert not list((tmp_path / "staged").rglob("*.parquet"))


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], 0.5)], "id long, words array<string>, x double")
    staged = session.stage(df)
    assert staged.schema == df.schema and sorted(map(str, staged.collect())) == sorted(map(str, df.collect()))
    assert len(staged.inputFiles()) >= 1 and spark.sparkContext.applicationId in staged.inputFiles()[0]
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()
