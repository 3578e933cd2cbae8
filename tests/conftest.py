import signal
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{at}/shared")
        .config("spark.sql.warehouse.dir", f"{at}/warehouse")
        .config("spark.local.dir", f"{at}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _not_forever(request):
    """A test that hangs fails instead of holding up the rest."""
    limit = request.node.get_closest_marker("seconds")

    def stop(*_):
        raise TimeoutError("test took too long")

    signal.signal(signal.SIGALRM, stop)
    signal.alarm(limit.args[0] if limit else 90)
    yield
    signal.alarm(0)
