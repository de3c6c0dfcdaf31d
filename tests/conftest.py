import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from datalumen.session import get_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tables(spark):
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages "
             "benchmark labels conversations").split()
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in names}


@pytest.fixture(scope="session")
def sales(spark):
    """A small shop table of the shape described in FIXTURES.md, with its kinds of defects."""
    rows = []
    cats = ["Home", "Garden", "Toys"]
    for i in range(30):
        rows.append((
            f"TX{1000 + i}", f"CUST-{i % 25:03d}", f"2025-01-{1 + i % 13:02d}", None if i == 4 else float(20 + i),
            ["F", "Female", "M", " male "][i % 4], cats[i % 3], 1 + i % 4, 2500.0 if i == 20 else 50.0 + i,
            "$1,2%02d.50" % i, "Yes" if i % 8 == 0 else "No",
        ))
    rows.append(rows[7])
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, transaction_date string, "
                                 "customer_age double, customer_gender string, product_category string, "
                                 "units_sold bigint, total_spend double, price_text string, is_returned string")
