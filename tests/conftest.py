import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

from glyphflow.plans.excerpts import EXCERPTS  # noqa: E402

_FOLDER = tempfile.TemporaryDirectory()
for _name, _lines in EXCERPTS.items():
    Path(_FOLDER.name, f"{_name}.txt").write_text(_lines.strip("\n") + "\n", encoding="utf-8")
os.environ.setdefault("GLYPHFLOW_DICTIONARIES", _FOLDER.name)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
