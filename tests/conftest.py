import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def master(spark, sf_dir):
    from subscope.plans import fixtures

    return fixtures.master(spark, sf_dir)


# five customers and nine events with hand-computed results
PROFILE_ROWS = [
    ("1", "Male", 0, "Yes", "No", 12, "Yes", "No", "DSL", "Yes", "No", "Yes", "Yes", "No", "No", "One year", "Yes", "Mailed check", 50.0, "600.0", "No"),
    ("2", "Female", 1, "No", "Yes", 24, "Yes", "Yes", "Fiber optic", "No", "Yes", "No", "Yes", "No", "No", "Month-to-month", "No", "Electronic check", 80.0, "1920.0", "No"),
    ("3", "Male", 0, "Yes", "No", 6, "No", "No phone service", "DSL", "Yes", "Yes", "No", "No", "No", "No", "Month-to-month", "Yes", "Bank transfer (automatic)", 30.0, "180.0", "Yes"),
    ("4", "Female", 0, "No", "No", 72, "Yes", "Yes", "No", "No", "No", "No", "No", "No", "No", "Two year", "Yes", "Credit card (automatic)", 20.0, "1440.0", "No"),
    ("5", "Male", 1, "No", "No", 1, "Yes", "No", "Fiber optic", "No", "No", "No", "No", "No", "No", "Month-to-month", "Yes", "Electronic check", 70.0, "70.0", "Yes"),
]
EVENT_ROWS = [
    ("1", "2026-07-01", "RECHARGE", 500.0, None, None, "APP", None, "False"),
    ("1", "2026-07-15", "DATA_SESSION", None, 350.5, None, "WEB", "DATA_BUNDLE_1GB", "True"),
    ("2", "2026-07-05", "RECHARGE", 1000.0, None, None, "USSD", None, "False"),
    ("2", "2026-07-20", "CALL", None, None, 5.5, "APP", None, "False"),
    ("3", "2026-07-10", "RECHARGE", 200.0, None, None, "AGENT", None, "False"),
    ("3", "2026-07-22", "SMS", None, None, None, "USSD", None, "False"),
    ("4", "2026-07-02", "RECHARGE", 1500.0, None, None, "WEB", "VOICE_TOPUP_100", "True"),
    ("4", "2026-07-28", "DATA_SESSION", None, 1200.0, None, "APP", None, "False"),
    ("5", "2026-07-03", "RECHARGE", 100.0, None, None, "USSD", None, "False"),
]


@pytest.fixture(scope="session")
def small(spark):
    """(profiles, events) of the five customers."""
    from pyspark.sql import functions as F

    from subscope import constants as K
    from subscope.sources.contracts import PROFILE_SCHEMA

    profiles = spark.createDataFrame(PROFILE_ROWS, PROFILE_SCHEMA)
    types = [
        "string", "string", "string", "double", "double", "double", "string", "string", "string",
    ]
    schema = ", ".join(f"{c} {t}" for c, t in zip(K.EVENT_COLUMNS, types))
    events = spark.createDataFrame(EVENT_ROWS, schema).withColumn("event_date", F.col("event_date").cast("date"))
    return profiles, events


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def frame(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


pytest.rows, pytest.frame, pytest.pd = rows, frame, pd
