import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from driftmart.plans.queries import REGISTRY
from driftmart.session import shared_folder
from driftmart.sources import files
from driftmart.sources.schemas import EVENTS, TABLES

EVENTS_CSV = '''event_id,station_id,event_date,event_type,severity,duration_hours
1,101,2024-01-03,maintenance,low,2.5
2,101,2024-01-04,"sensor, fault",high,
3,,2024-02-01,"say ""stop""",critical,NaN
'''


def write(tmp_path, text, name="events.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_load(spark, tmp_path):
    rows = files.read_csv(spark, write(tmp_path, EVENTS_CSV), EVENTS).orderBy("event_id").collect()
    assert [r.event_type for r in rows] == ["maintenance", "sensor, fault", 'say "stop"']
    assert [r.duration_hours for r in rows] == [2.5, None, None]
    assert rows[2].station_id is None and str(rows[0].event_date) == "2024-01-03"


@pytest.mark.parametrize(
    "text",
    [
        EVENTS_CSV.replace("event_date,event_type", "event_type,event_date"),
        EVENTS_CSV.replace("2024-01-04", "yesterday"),
    ],
)
def test_csv_load_fails_on_wrong_header_or_value(spark, tmp_path, text):
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD|CSV header"):
        files.read_csv(spark, write(tmp_path, text), EVENTS).collect()


def test_load_tables_and_views(spark, tmp_path):
    for name, schema in TABLES.items():
        write(tmp_path, ",".join(schema.names) + "\n", f"{name}.csv")
    write(tmp_path, EVENTS_CSV)
    tables = files.load_tables(spark, str(tmp_path))
    files.register_views(tables)
    assert spark.sql("SELECT count(*) FROM events").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM measurements").first()[0] == 0


def test_round_trips(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path, EVENTS_CSV), EVENTS)
    files.write_csv(df, str(tmp_path / "out.csv"))
    files.write_parquet(df, str(tmp_path / "out.parquet"), cluster_by=["station_id"])
    expected = sorted(map(str, df.collect()))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "out.csv"), EVENTS).collect())) == expected
    assert sorted(map(str, files.read_parquet(spark, str(tmp_path / "out.parquet")).collect())) == expected
    with pytest.raises(PySparkException):
        files.write_csv(df, str(tmp_path / "out.csv"))


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, "app-1"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        raise AssertionError("the session's checkpoint folder is not ours to set")


class FakeSession:
    def __init__(self, context, setting=None):
        self.sparkContext, self.setting, self.conf = context, setting, self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default


def test_shared_folder_follows_the_cluster_setting():
    session = FakeSession(FakeContext("yarn"), "hdfs://shared/scratch/")
    first, second = (shared_folder(session, "x") for _ in range(2))
    assert first.startswith("hdfs://shared/scratch/driftmart-x-") and first != second


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_shared_folder_is_never_local_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(FakeContext(master)), "x")


def test_one_shared_folder_in_local_mode_and_no_setting_changed():
    session = FakeSession(FakeContext("local[2]"))
    first, second = (shared_folder(session, "x") for _ in range(2))
    assert os.path.dirname(first) == os.path.dirname(second) and first != second
    assert session.sparkContext.folder is None and session.setting is None


def test_compressed_csv_keeps_every_value(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path, EVENTS_CSV), EVENTS)
    files.write_csv(df, str(tmp_path / "out.csv"), compression="gzip")
    again = files.read_csv(spark, str(tmp_path / "out.csv"), EVENTS)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert all(path.endswith(".csv.gz") for path in again.inputFiles())


def test_mart_is_exported_compressed(spark, small):
    exported, direct = (REGISTRY[name](spark, small) for name in ("csv_mart_roundtrip", "monitoring_mart"))
    assert exported.inputFiles() and all(path.endswith(".csv.gz") for path in exported.inputFiles())
    assert sorted(map(str, exported.collect())) == sorted(map(str, direct.collect()))
