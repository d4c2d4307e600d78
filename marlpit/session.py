"""The session settings the library relies on."""

from pyspark.sql import SparkSession


def session(app: str = "marlpit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    pinned = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=pinned | conf).getOrCreate()
