"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed values. A repeated JSON key keeps its first position and takes its last value, and
# timestamps are read as UTC.
REQUIRED_SETTINGS = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the required settings on a session and return it."""
    for name, value in REQUIRED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def require_settings(spark: SparkSession) -> None:
    """Fail early when a setting would change results."""
    for name, value in REQUIRED_SETTINGS.items():
        actual = spark.conf.get(name, None)
        if actual is None or actual.lower() != value.lower():
            raise ValueError(
                f"{name} is {actual!r} but must be {value!r}; "
                "call keydrift.plans.session.configure(spark)"
            )
