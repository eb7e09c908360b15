from __future__ import annotations

import pytest

from sensorgrid.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
