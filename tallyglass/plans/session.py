"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: joins by measured size, split skewed join partitions, merge tiny ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Dates and times carry no zone; a fixed zone keeps formatted parsing stable.
    "spark.sql.session.timeZone": "UTC",
}

# For inputs whose rows come in another order when a task is rerun: Spark then notices the change
# and reruns the whole stage instead of mixing both. Costs about a fifth of shuffle time, and
# nothing here needs it as long as row numbering reads files, so it is not on by default.
RERUN_CHECKS = {
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
}


def shuffle_partitions(shuffled_bytes: int, target: int = 256 * 2**20, least: int = 8) -> int:
    """Shuffle partitions so that each holds about ``target`` bytes (100 TB: about 400,000)."""
    return max(least, -(-shuffled_bytes // target))


def build_session(
    name: str = "tallyglass",
    master: str | None = None,
    shuffled_bytes: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with the settings above; give the size of the largest shuffle to size partitions."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    chosen = dict(SETTINGS)
    if shuffled_bytes is not None:
        chosen["spark.sql.shuffle.partitions"] = str(shuffle_partitions(shuffled_bytes))
    chosen.update(settings)
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
