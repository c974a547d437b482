import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import local_session

LEDGER = ("account string, txn_ts timestamp_ntz, description string, amount decimal(28,4), "
          "source_file string, row_id bigint")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_ledger(spark):
    """Ledger from ``(day or timestamp, description, amount[, account])`` rows."""
    def build(rows, account="Checking"):
        full = []
        for i, row in enumerate(rows):
            day, description, amount, *rest = row
            moment = dt.datetime.fromisoformat(day)
            full.append((rest[0] if rest else account, moment, description,
                         Decimal(str(amount)), "test", i))
        return spark.createDataFrame(full, LEDGER)
    return build


def amounts(df, key="line_key", value="amount"):
    return {r[key]: float(r[value]) for r in df.collect()}
