import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(home / "checkpoints")).config("spark.sql.warehouse.dir", str(home / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


NOTE = "note_id bigint, vault string, path string, basename string, folder string, content string, aliases string, tags string, headings string, lang string, indexed_at timestamp"


@pytest.fixture(scope="session")
def make_notes(spark):
    """Makes a table of notes from dicts; what isn't given is null, indexed_at the same for all."""
    from datetime import datetime

    names = [c.split(" ")[0] for c in NOTE.split(", ")]

    def make(*rows, extra=None):
        full = [{"path": f"a/n{r.get('note_id')}.md", "vault": "v", "folder": "a/", "indexed_at": datetime(2024, 1, 1)} | r for r in rows]
        df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], NOTE)
        return df if extra is None else df.selectExpr("*", *extra)

    return make
