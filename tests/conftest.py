import os
import tempfile

import pytest

from caselake.session import build_session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="caselake-tests-")
    s = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"), {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": scratch, "spark.sql.files.openCostInBytes": "134217728"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
