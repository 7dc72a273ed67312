import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HOURLY_SQL = """\
/* Hourly levels of each gauge; readings arrive under an old name */
CREATE OR REPLACE TABLE level AS
WITH latest AS (
    SELECT gauge_id, max(taken_at) AS taken_at FROM rd_old GROUP BY gauge_id
)
SELECT r.gauge_id, date_trunc('hour', r.taken_at) AS hour, avg(r.height) AS height
FROM rd_old r JOIN latest USING (gauge_id)
GROUP BY 1, 2;

DELETE FROM reading WHERE height < 0; -- broken floats; see "notes"
"""

GAUGES_PY = '''\
from pathlib import Path
from warehouse import connect

CONFIG = Path("gauges.toml")


class Gauges:
    """Where the gauges stand."""

    def near(self, river):
        return connect().sql(f"SELECT * FROM gauge_tbl JOIN station ON gauge_tbl.st = station.st WHERE river = {river!r}")


def publish(frame):
    frame.write.mode("append").saveAsTable("hydro.flood_warning")
'''

NIGHTLY_SH = """\
#!/bin/sh
fetch() {
  bq query --quiet "SELECT count(*) FROM reading"
}

# move the day's file
snowsql -q "COPY INTO rd_raw FROM @inbox/today.csv"
fetch && echo "moved"
"""

STATIONS_SQL = """\
MERGE INTO stn_tab AS t USING station_inbox AS i ON t.st = i.st
WHEN MATCHED THEN UPDATE SET name = i.name;
"""


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.TemporaryDirectory(prefix="tabletrail-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared.name)
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shared.cleanup()


@pytest.fixture
def script_folder(tmp_path):
    root = tmp_path / "scripts"
    files = {
        "levels/hourly.sql": HOURLY_SQL,
        "levels/gauges.py": GAUGES_PY,
        "nightly.sh": NIGHTLY_SH,
        "stations.sql": STATIONS_SQL,
        "retired/2009/levels.py": "x = pd.read_sql('SELECT * FROM level_2009', db)\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root
