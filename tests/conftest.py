import pytest

from tallyframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_sql_warehouse_dir": "/tmp/tallyframe-warehouse", "spark_driver_memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
