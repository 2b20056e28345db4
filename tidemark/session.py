"""Session settings that the operators rely on, and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps comparable with epoch arithmetic; the RocksDB provider is what transformWithState needs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
