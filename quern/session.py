"""The session settings the library is written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "quern", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; ``conf`` wins over the defaults."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that ``spark.checkpoint.dir`` names, and read from there; only a local session without that setting gets a folder of its own."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if sc.getCheckpointDir() is None:
        shared = conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="quern-checkpoints-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)
    return df.checkpoint()
