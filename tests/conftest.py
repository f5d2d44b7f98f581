from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from graspmeter.session import CHECKPOINT_CONF, configure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get(CHECKPOINT_CONF, None):
        session.conf.set(CHECKPOINT_CONF, str(tmp_path_factory.mktemp("shared")))
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def source_files(spark, **texts: str):
    """Files table of named sources; ``x_py`` is a Python file, all others are TypeScript."""
    rows = []
    for name, text in texts.items():
        python = name.endswith("_py")
        path = f"{name}.py" if python else f"{name}.ts"
        rows.append((path, path, path, "python" if python else "typescript", "repo", text))
    return spark.createDataFrame(
        rows, "file_id string, path string, relative_path string, language string, repo string, content string"
    )


@pytest.fixture(scope="session")
def files(spark):
    return lambda **texts: source_files(spark, **texts)
