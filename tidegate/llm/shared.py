"""The package's intermediate tables under the name that this subpackage uses, and the size of batches for Python."""

from pyspark.sql import SparkSession

from tidegate.stash import Stash, shared_dir

__all__ = ["Stash", "bounded_batches", "shared_dir"]

#: Rows and bytes that a task hands to Python at a time, where the session has Spark's own values.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_OWN: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long, so that Spark's own number of rows in a batch is no bound on memory. Settings that a user has
    changed stay as they are."""
    if not _OWN:
        fresh = spark.newSession()
        given = dict(spark.sparkContext.getConf().getAll())
        _OWN.update({k: fresh.conf.get(k) for k in BATCH if k not in given})
    for k, own in _OWN.items():
        if spark.conf.get(k) == own:
            spark.conf.set(k, BATCH[k])
