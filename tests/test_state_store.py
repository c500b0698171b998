"""Which store a stream keeps its state in, whatever built its session."""

import json
import os

import pytest

from perkflow.operators.summary import member_window_summary
from perkflow.session import STATE_CONF
from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.streaming import changelog
from perkflow.streaming.summary_stream import run_to_completion, start_summary_changelog, summary_stream
from tests.helpers import tx_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROWS = [(1, 1, "A", "bet", 50, "slot", "2024-01-01 10:00:01"), (2, 2, "B", "win", 700, "slot", "2024-01-01 10:00:02"),
        (3, 1, "A", "bet", 60, "slot", "2024-01-01 10:01:00"), (4, 2, "B", "bet", 10, None, "2024-01-01 10:06:00")]


@pytest.fixture()
def plain(spark):
    """A session without the library's settings for streaming state."""
    session = spark.newSession()
    for k in STATE_CONF:
        session.conf.unset(k)
    return session


def run(session, folder):
    tx = session.readStream.schema(session.read.parquet(f"{folder}/in/0").schema).parquet(f"{folder}/in/*")
    run_to_completion(start_summary_changelog(summary_stream(tx), f"{folder}/log", f"{folder}/ckpt", n_state_partitions=2))


def store_of(folder, batch=0):
    """The state store that the stream's checkpoint names for a batch."""
    with open(f"{folder}/ckpt/offsets/{batch}") as f:
        return json.loads(f.read().split("\n")[1])["conf"][PROVIDER]


def check(session, folder, rows):
    got, want = changelog.current_summary(session, f"{folder}/log"), member_window_summary(tx_rows(session, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*SUMMARY_COLUMNS).collect()))


def test_a_session_built_elsewhere_keeps_no_state_on_the_heap(plain, tmp_dir):
    tx_rows(plain, ROWS).write.parquet(f"{tmp_dir}/in/0")
    before = plain.conf.get("spark.sql.shuffle.partitions")
    run(plain, tmp_dir)
    assert store_of(tmp_dir) == STATE_CONF[PROVIDER] and "RocksDB" in STATE_CONF[PROVIDER]
    assert all(plain.conf.get(k, None) is None for k in STATE_CONF)         # only around the start
    assert plain.conf.get("spark.sql.shuffle.partitions") == before
    check(plain, tmp_dir, ROWS)


def test_native_memory_of_the_state_is_bounded(spark):
    for session in (STATE_CONF, {k: spark.conf.get(k) for k in STATE_CONF}):
        assert session["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"
        assert int(session["spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB"]) <= 500


def test_the_store_that_a_session_or_a_checkpoint_names_holds(plain, tmp_dir):
    tx_rows(plain, ROWS[:2]).write.parquet(f"{tmp_dir}/in/0")
    plain.conf.set(PROVIDER, ON_HEAP)
    run(plain, tmp_dir)
    assert plain.conf.get(PROVIDER) == ON_HEAP
    plain.conf.unset(PROVIDER)
    tx_rows(plain, ROWS[3:]).write.parquet(f"{tmp_dir}/in/1")
    run(plain, tmp_dir)                                                     # started with another store before
    newest = max(int(n) for n in os.listdir(f"{tmp_dir}/ckpt/offsets") if n.isdigit())
    assert newest > 0 and store_of(tmp_dir) == store_of(tmp_dir, newest) == ON_HEAP
    check(plain, tmp_dir, ROWS[:2] + ROWS[3:])
