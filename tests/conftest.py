import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crosstide.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "4",
        "crosstide-tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.driver.memory": "4g",
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:ReservedCodeCacheSize=400m",
            "spark.sql.codegen.wholeStage": "false",
        },
    )
    yield session
    session.stop()
