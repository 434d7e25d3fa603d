"""Session settings the plans rely on, and where lineage cuts are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution does three jobs here: it turns a shuffled join into a
#: broadcast join only once the measured side is small, it splits skewed join
#: partitions, and it coalesces the small partitions of pre-aggregated data.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[*]", app: str = "meterlens", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster, pass its own partition count."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the SQL settings on a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Only a session without that setting (a test) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="meterlens-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
