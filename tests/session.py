from __future__ import annotations

import os
import tempfile

from sparkgrid.session import build_session


def make_session():
    spark = build_session("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", **{
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sparkgrid-tests-"),
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    return spark
