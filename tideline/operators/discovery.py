"""A service registry kept in the log: instances are JSON values under their service's prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.state import latest, prefix_scan

#: What an instance's JSON holds.
SCHEMA = "serviceName string, instanceId string, address struct<host: string, port: int>, metadata map<string, string>, leaseId bigint, _corrupt_record string"


def key_of(service: Column, instance: Column) -> Column:
    return F.concat(F.lit("services/"), service, F.lit("/instances/"), instance)


def prefix_of(service: str) -> str:
    return f"services/{service}/instances/"


def registered(instances: DataFrame, ttl_ms: int) -> DataFrame:
    """Records (key, value, lease_id) for instances (service, instance, host, port, metadata, lease_id)
    that may register; blank names and ids may not, nor may any without a positive ttl."""
    if ttl_ms <= 0:
        raise ValueError("ttl_ms must be positive")
    rows = instances.where("trim(service) <> '' and trim(instance) <> ''")
    body = F.struct(F.col("service").alias("serviceName"), F.col("instance").alias("instanceId"), F.struct("host", "port").alias("address"), F.col("metadata"), F.col("lease_id").alias("leaseId"))
    return rows.select(key_of(F.col("service"), F.col("instance")).alias("key"), F.to_json(body).alias("value"), "lease_id")


def unregistered(log: DataFrame, handles: DataFrame) -> DataFrame:
    """Of handles (key, revision) those that still hold: their key is at that revision, and is to be deleted."""
    now = latest(log).select("key", F.col("revision").alias("__now"))
    return handles.join(now, "key", "left").where(F.coalesce("__now", F.lit(0)) == F.col("revision")).drop("__now")


def decoded(rows: DataFrame) -> DataFrame:
    """Instances among rows (key, value, ...); what isn't an instance's JSON is left out."""
    rows = rows.withColumn("i", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = rows.where("i is not null and i._corrupt_record is null")
    return rows.select("key", F.col("i.serviceName").alias("service"), F.col("i.instanceId").alias("instance"), F.col("i.address.host").alias("host"), F.col("i.address.port").alias("port"), F.col("i.metadata").alias("metadata"), F.col("i.leaseId").alias("lease_id"), "revision")


def instances(log: DataFrame, service: str) -> DataFrame:
    """The live instances of a service."""
    return decoded(prefix_scan(log, prefix_of(service)))
