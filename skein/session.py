"""Session settings that the engine relies on."""

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with ``CONF``; keyword arguments are further settings, dots written as double underscores."""
    b = SparkSession.builder.master(master).config(map=CONF)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
