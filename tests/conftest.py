"""One local session, and the graph of harbour.py read from files."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path[:0] = [ROOT, str(Path(__file__).resolve().parent)]

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    from harbour import FILES

    path = tmp_path_factory.mktemp("graph")
    for name, lines in FILES.items():
        (path / name).write_text("\n".join(lines) + "\n")
    return path


@pytest.fixture(scope="session")
def graph(spark, folder):
    from lodegraph import from_files

    return from_files(spark, str(folder / "h.kg"), str(folder / "h.ui"), [str(folder / "h.ship"), str(folder / "h.port")])
