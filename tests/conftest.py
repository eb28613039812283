import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from muniframe.session import build_session

    session = build_session(
        "muniframe-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def scan_in_splits(spark, monkeypatch, size):
    """Scans of delimited files cut them into splits of ``size`` bytes; other reads go on as usual."""
    from muniframe.sources import bronze, files, records

    scan = records.chunks_of

    def small(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            return scan(*args)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    for module in (bronze, files, records):
        monkeypatch.setattr(module, "chunks_of", small)
