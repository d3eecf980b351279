"""Parallelism for CPU-heavy per-row stages, as the caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting: partitions to deal small inputs out to. Unset: the scan's splits stay.
SETTING = "pagelane.minPartitions"


def spread(df: DataFrame, keys=(), partitions: int | None = None) -> DataFrame:
    """Hash-repartition ``df`` by ``keys`` into as many partitions as the
    caller names, here or in the session setting ``pagelane.minPartitions``.

    For inputs with fewer splits than cores whose rows are costly to work on
    (a single Parquet file on many cores). Without the setting nothing is
    shuffled and the plan does not depend on the cluster's size.
    """
    target = int(partitions or df.sparkSession.conf.get(SETTING, None) or 0)
    if not target:
        return df
    return df.repartition(target, *[k for k in keys if k in df.columns])
