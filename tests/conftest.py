import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Documents from literal texts, with ids 0, 1, ..."""
    def make(*values):
        return spark.createDataFrame(
            [(str(i), v) for i, v in enumerate(values)], "doc_id string, text string")
    return make


@pytest.fixture(scope="session")
def spanned(spark):
    """Documents with given spans ``(entity_type, start, end)`` or with a confidence as fourth."""
    from piiloom.functions.spans import SPAN_TYPE

    def make(*docs):
        rows = []
        for i, (text, spans) in enumerate(docs):
            full = [(s[0], None, s[1], s[2], float(s[3]) if len(s) > 3 else 0.9, f"r{j}")
                    for j, s in enumerate(spans)]
            rows.append((str(i), f"f{i}.pdf", text, full))
        return spark.createDataFrame(
            rows, f"doc_id string, filename string, text string, spans {SPAN_TYPE}")
    return make
