"""Readers and writers: declared schemas, parquet tables, JSON wire format,
Kafka topic options, the events->transactions adapter, file sinks."""
