import pytest
from pyspark.sql import SparkSession

from queryscore.sources.database import columns_catalog, register_database


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def db_root(spark, tmp_path_factory):
    """A root with two databases that share a table name."""
    root = tmp_path_factory.mktemp("dbs")
    boats = [
        (1, "Alba", "Oslo"), (2, "Brisa", "Riga"), (3, "Cirrus", "Oslo"), (4, "Dorada", None), (5, None, "Faro"),
        (6, "Alba", "Faro"), (7, "Estrel", "Riga"), (7, "Estrel", "Riga"), (8, "Fjell", "Bergen"), (9, "Gaviota", "Faro"),
        (10, "Havn", "Oslo"), (11, "Isbre", None), (12, None, None), (13, "Jolle", "Bergen"), (14, "Kite", "Riga"),
        (15, "Lumi", "Turku"), (16, "Morsa", "Faro"), (17, "Njord", "Oslo"), (18, "Orca", "Turku"), (19, "Puffin", "Bergen"),
        (20, "Brisa", "Turku"), (21, "Quill", "Riga"),
    ]
    fees = [(k, k % 21 + 1, None if k % 5 == 0 else 12.5 * (k % 4)) for k in range(1, 31)]
    spark.createDataFrame(boats, "hull long, title string, harbour string").coalesce(1).write.parquet(
        str(root / "marina" / "boats.parquet")
    )
    spark.createDataFrame(fees, "slip long, berth long, fee double").coalesce(1).write.parquet(
        str(root / "marina" / "moorings.parquet")
    )
    spark.createDataFrame([(7, "Zephyr")], "hull long, title string").coalesce(1).write.parquet(
        str(root / "quarry" / "boats.parquet")
    )
    return str(root)


@pytest.fixture(scope="session")
def databases(spark, db_root):
    return spark.createDataFrame(
        [("marina", f"{db_root}/marina"), ("quarry", f"{db_root}/quarry")], "db_id string, dir string"
    )


@pytest.fixture(scope="session")
def marina(spark, db_root):
    session = spark.newSession()
    return {"marina": register_database(session, f"{db_root}/marina")}


@pytest.fixture(scope="session")
def marina_columns(spark, marina):
    return columns_catalog(spark, marina)


GOLD = "SELECT title FROM boats WHERE harbour='Oslo'"
