import tempfile

import pytest

from ledgerloom.session import session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    s = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"file://{folder}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
