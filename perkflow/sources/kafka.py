"""Kafka topic source and sink.

The Kafka connector jar is not part of pip PySpark; these functions only
assemble the reader/writer, so a session with the connector on its classpath
runs them unchanged. ``maxOffsetsPerTrigger`` is the ingest throttle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perkflow import config
from perkflow.sources.wire import decode_transactions, encode_value


def kafka_source_options(bootstrap_servers: str, topic: str = config.TRANSACTIONS_TOPIC,
                         starting_offsets: str = "earliest",
                         max_offsets_per_trigger: int | None = None,
                         extra: dict[str, str] | None = None,
                         fail_on_data_loss: bool = True) -> dict[str, str]:
    """Reader options. Offsets that are gone from the broker fail the query unless told otherwise."""
    opts = {
        "kafka.bootstrap.servers": bootstrap_servers,
        "subscribe": topic,
        # only the first start honours this; afterwards the checkpoint wins
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    opts.update(extra or {})
    return opts


def kafka_transactions_stream(spark: SparkSession, bootstrap_servers: str,
                              topic: str = config.TRANSACTIONS_TOPIC,
                              starting_offsets: str = "earliest",
                              max_offsets_per_trigger: int | None = None,
                              keep_corrupt: bool = True, fail_on_data_loss: bool = True) -> DataFrame:
    """readStream from the topic, decoded to typed transaction columns."""
    opts = kafka_source_options(bootstrap_servers, topic, starting_offsets, max_offsets_per_trigger,
                                fail_on_data_loss=fail_on_data_loss)
    try:
        raw = spark.readStream.format("kafka").options(**opts).load()
    except Exception as e:  # noqa: BLE001 - re-raised with the fix
        if "kafka" in str(e).lower() and "data source" in str(e).lower():
            raise RuntimeError(
                "the Kafka connector is not on the classpath; start Spark with the "
                "spark-sql-kafka-0-10 package matching this Spark version") from e
        raise
    return decode_transactions(raw, "value", keep_corrupt=keep_corrupt)


def kafka_sink_options(bootstrap_servers: str, topic: str = config.TRANSACTIONS_TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic, "kafka.acks": "all"}


def to_kafka_records(df: DataFrame) -> DataFrame:
    """Rows -> Kafka records: JSON ``value``, no key."""
    return df.select(encode_value(df).alias("value"))


def write_kafka_stream(df: DataFrame, bootstrap_servers: str, checkpoint_location: str,
                       topic: str = config.TRANSACTIONS_TOPIC):
    """Start a streaming write of ``df`` to the topic (acks=all)."""
    return (to_kafka_records(df).writeStream.format("kafka")
            .options(**kafka_sink_options(bootstrap_servers, topic))
            .option("checkpointLocation", checkpoint_location)
            .start())


def write_kafka_batch(df: DataFrame, bootstrap_servers: str,
                      topic: str = config.TRANSACTIONS_TOPIC) -> None:
    to_kafka_records(df).write.format("kafka").options(**kafka_sink_options(bootstrap_servers, topic)).save()
