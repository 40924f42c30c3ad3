import pytest


@pytest.fixture(scope="session", autouse=True)
def _checkpoint_folder(spark, tmp_path_factory):
    """Written intermediate tables go to the test run's own folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
