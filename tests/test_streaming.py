"""Stream = batch, late rows, restart on the same checkpoint, retraction, ledger stream."""

import os
import time

from pyspark.sql import functions as F

from perkflow.operators import ledger as ledger_ops
from perkflow.operators.summary import member_window_summary
from perkflow.plans.inputs import Inputs
from perkflow.sources.files import stream_json_transactions
from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.sources.sinks import write_ndjson
from perkflow.streaming import changelog
from perkflow.streaming.ledger_stream import start_redemption_stream
from perkflow.streaming.summary_stream import (LateRows, run_to_completion, start_summary_changelog,
                                               start_summary_on_close, summary_stream, to_wall_time)
from tests.conftest import SF_SMALL
from tests.helpers import tx_rows


def _write_parts(df, folder, bounds, time_col="transaction_time"):
    """One JSON-lines folder per time slice, written in time order."""
    edges = [None] + bounds + [None]
    for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        part = df
        if lo is not None:
            part = part.where(F.col(time_col) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            part = part.where(F.col(time_col) < F.lit(hi).cast("timestamp_ntz"))
        write_ndjson(part.coalesce(1), os.path.join(folder, f"part-{n:03d}"))
        time.sleep(0.05)


def _rows(df, cols=SUMMARY_COLUMNS):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _truncated_tx(spark):
    tx = Inputs(spark, SF_SMALL).tx()
    return tx.withColumn("transaction_time", F.date_trunc("second", "transaction_time").cast("timestamp_ntz"))


def test_stream_equals_batch_over_many_files(spark, tmp_dir):
    tx = _truncated_tx(spark)
    _write_parts(tx, f"{tmp_dir}/in", ["2024-01-08", "2024-01-15", "2024-01-22"])
    stream = stream_json_transactions(spark, f"{tmp_dir}/in/*", max_files_per_trigger=1, keep_corrupt=False)
    q = start_summary_changelog(summary_stream(stream), f"{tmp_dir}/log", f"{tmp_dir}/ckpt",
                                files_per_batch=2)
    run_to_completion(q)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 4
    import glob
    assert all(len(glob.glob(f"{d}/*.parquet")) <= 2 for d in glob.glob(f"{tmp_dir}/log/batch_id=*"))
    got = changelog.current_summary(spark, f"{tmp_dir}/log")
    want = member_window_summary(tx)
    assert _rows(got) == _rows(want)
    # the change log has several versions of some keys only if windows spanned batches;
    # every version is a complete row of the summary shape
    assert set(changelog.read_changelog(spark, f"{tmp_dir}/log").columns) >= set(SUMMARY_COLUMNS)


def test_append_mode_emits_closed_windows_once(spark, tmp_dir):
    tx = _truncated_tx(spark)
    _write_parts(tx, f"{tmp_dir}/in", ["2024-01-15"])
    stream = stream_json_transactions(spark, f"{tmp_dir}/in/*", max_files_per_trigger=1, keep_corrupt=False)
    q = start_summary_on_close(summary_stream(stream), f"{tmp_dir}/closed", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    got = spark.read.option("basePath", f"{tmp_dir}/closed").parquet(f"{tmp_dir}/closed")
    want = member_window_summary(tx)
    max_t = tx.agg(F.max("transaction_time")).collect()[0][0]
    import datetime as dt
    closed = want.where(F.col("window_end") <= F.lit(max_t - dt.timedelta(seconds=10)))
    assert got.count() == closed.count() == want.count() - 1
    assert _rows(got) == _rows(closed)


def test_late_row_dropped_after_watermark_moves(spark, tmp_dir):
    # Spark filters late rows against the previous batch's watermark, so the
    # late file comes one batch after the file that moved the watermark.
    early = tx_rows(spark, [(1, 1, "A", "bet", 100, "slot", "2024-01-01 10:00:01"),
                            (2, 1, "A", "bet", 100, "slot", "2024-01-01 11:00:00")])
    more = tx_rows(spark, [(5, 3, "C", "bet", 100, "slot", "2024-01-01 11:00:20")])
    late = tx_rows(spark, [(3, 2, "B", "bet", 100, "slot", "2024-01-01 10:00:05"),   # window closed
                           (4, 2, "B", "bet", 100, "slot", "2024-01-01 10:59:55")])  # within 10 s
    for n, df in enumerate([early, more, late]):
        write_ndjson(df.coalesce(1), f"{tmp_dir}/in/part-{n}")
        time.sleep(0.05)
    stream = stream_json_transactions(spark, f"{tmp_dir}/in/*", max_files_per_trigger=1, keep_corrupt=False)
    late_rows = LateRows()
    spark.streams.addListener(late_rows)
    q = start_summary_changelog(summary_stream(stream), f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    total = late_rows.total(q)
    spark.streams.removeListener(late_rows)
    got = changelog.current_summary(spark, f"{tmp_dir}/log")
    keys = {(r.member_id, str(r.window_start)) for r in got.collect()}
    assert (2, "2024-01-01 10:00:00") not in keys     # dropped as late
    assert (2, "2024-01-01 10:55:00") in keys         # allowed lateness
    assert total == 1


def test_restart_on_same_checkpoint(spark, tmp_dir):
    tx = _truncated_tx(spark)
    parts = f"{tmp_dir}/in"
    os.makedirs(parts)
    first = tx.where(F.col("transaction_time") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second = tx.where(F.col("transaction_time") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    write_ndjson(first.coalesce(1), f"{parts}/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{parts}/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    time.sleep(0.05)
    write_ndjson(second.coalesce(1), f"{parts}/part-1")
    q2 = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{parts}/*", 1, False)),
                                 f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q2)
    # the restarted query only read the new file
    assert sum(p["numInputRows"] for p in q2.recentProgress) == second.count()
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log")) == _rows(member_window_summary(tx))


def test_drink_offer_retracted_by_later_win(spark, tmp_dir):
    write_ndjson(tx_rows(spark, [(1, 1, "A", "bet", 2000, "slot", "2024-01-01 10:00:01")]).coalesce(1),
                 f"{tmp_dir}/in/part-0")
    time.sleep(0.05)
    write_ndjson(tx_rows(spark, [(2, 1, "A", "win", 1500, "slot", "2024-01-01 10:01:00")]).coalesce(1),
                 f"{tmp_dir}/in/part-1")
    stream = stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)
    q = start_summary_changelog(summary_stream(stream), f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    log = changelog.read_changelog(spark, f"{tmp_dir}/log")
    assert log.count() == 2                               # two versions of the window
    assert changelog.current_drink_offers(spark, f"{tmp_dir}/log").count() == 0
    assert changelog.current_summary(spark, f"{tmp_dir}/log").collect()[0].net_amount == -500


def test_compaction_writes_each_closed_window_once(spark, tmp_dir):
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    n1 = changelog.compact_changelog(spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt", "2024-01-15")
    n2 = changelog.compact_changelog(spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt", "2024-01-15")
    want = member_window_summary(tx).where(F.col("window_end") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    assert n1 == want.count() and n2 == 0
    assert _rows(spark.read.parquet(f"{tmp_dir}/table")) == _rows(want)
    n3 = changelog.compact_changelog(spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt", "2024-01-20")
    assert n3 > 0
    # compacted table + newer change-log rows == the whole current state
    both = changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")
    assert _rows(both) == _rows(member_window_summary(tx))


def test_ledger_stream_and_flagged_offers(spark, tmp_dir):
    req = spark.createDataFrame(
        [(1, "A", "hotel", "2024-01-01 10:10:00"), (1, "A", "hotel", "2024-01-01 10:20:00"),
         (2, "B", "drink", "2024-01-01 11:00:00")],
        "member_id long, member_name string, offer_type string, requested_at string") \
        .withColumn("requested_at", F.col("requested_at").cast("timestamp_ntz"))
    fmt = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    req.coalesce(1).write.options(**fmt).json(f"{tmp_dir}/req/part-0")
    time.sleep(0.05)
    req.coalesce(1).write.options(**fmt).json(f"{tmp_dir}/req/part-1")   # re-sent batch
    stream = (spark.readStream.schema("member_id long, member_name string, offer_type string, "
                                      "requested_at timestamp_ntz")
              .options(**fmt).option("maxFilesPerTrigger", "1").json(f"{tmp_dir}/req/*"))
    run_to_completion(start_redemption_stream(stream, f"{tmp_dir}/ledger", f"{tmp_dir}/ckpt"))
    led = ledger_ops.read_ledger(spark, f"{tmp_dir}/ledger")
    assert sorted((r.member_id, r.offer_type, str(r.redeemed_at)) for r in led.collect()) == [
        (1, "hotel", "2024-01-01 10:10:00"), (2, "drink", "2024-01-01 11:00:00")]

    tx = tx_rows(spark, [(1, 1, "A", "bet", 6000, "slot", "2024-01-01 10:00:01"),
                         (2, 3, "C", "bet", 6000, "slot", "2024-01-01 10:00:01")])
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/tx/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/tx/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt2")
    run_to_completion(q)

    def flags(day):
        rows = changelog.flagged_offers(spark, f"{tmp_dir}/log", f"{tmp_dir}/ledger", "hotel", day).collect()
        return {r.member_id: r.already_redeemed for r in rows}

    assert flags("2024-01-01") == {1: True, 3: False}
    # a redemption after the window's last change shows at the next read, a new day clears the flags
    later = spark.createDataFrame([(3, "C", "hotel", "2024-01-01 12:00:00")],
                                  "member_id long, member_name string, offer_type string, requested_at string") \
        .withColumn("requested_at", F.col("requested_at").cast("timestamp_ntz"))
    assert ledger_ops.append_redemptions(spark, later, f"{tmp_dir}/ledger") == 1
    assert flags("2024-01-01") == {1: True, 3: True}
    assert flags("2024-01-02") == {1: False, 3: False}


def test_interrupted_compaction_loses_nothing(spark, tmp_dir, monkeypatch):
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    args = (spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt")
    want = _rows(member_window_summary(tx))
    assert changelog.compact_changelog(*args, "2024-01-10") > 0

    def broken(*_):
        raise OSError("lost before the commit")
    with monkeypatch.context() as m:
        m.setattr(changelog, "_commit_boundary", broken)
        try:
            changelog.compact_changelog(*args, "2024-01-20")
        except OSError:
            pass
    # a part of the days is in the table, uncommitted: remove all but one of the new ones
    import glob
    import shutil
    for d in sorted(glob.glob(f"{tmp_dir}/table/window_date=2024-01-1[1-9]"))[1:]:
        shutil.rmtree(d)
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want
    assert changelog.compact_changelog(*args, "2024-01-20") > 0
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want
    assert changelog.compact_changelog(*args) > 0        # up to the watermark
    assert changelog.compact_changelog(*args) == 0
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want


def test_compaction_replaces_nothing_that_is_committed(spark, tmp_dir, monkeypatch):
    """A run that stops after its files are there, whatever its boundary, neither loses nor repeats a row."""
    import glob
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    args = (spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt")
    want = _rows(member_window_summary(tx))
    assert changelog.compact_changelog(*args, "2024-01-10 12:00:00") > 0     # within a day
    first = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_dir}/table/**/*.parquet", recursive=True)}

    def broken(*_):
        raise OSError("lost before the commit")
    for until in ("2024-01-10 18:00:00", "2024-01-20"):
        with monkeypatch.context() as m:
            m.setattr(changelog, "_commit_boundary", broken)
            try:
                changelog.compact_changelog(*args, until)
            except OSError:
                pass
        assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want
    assert changelog.compact_changelog(*args, "2024-01-15") > 0
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want
    assert changelog.compact_changelog(*args) > 0
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")) == want
    assert all(os.path.getmtime(f) == t for f, t in first.items())


def test_compaction_above_the_watermark_is_refused(spark, tmp_dir):
    import pytest
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    with pytest.raises(ValueError, match="watermark"):
        changelog.compact_changelog(spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt", "2030-01-01")
    assert changelog.committed_boundary(spark, f"{tmp_dir}/table") is None


def test_stream_reads_a_folder_of_part_files(spark, tmp_dir):
    from perkflow.plans.inputs import Inputs
    from perkflow.streaming.summary_stream import events_transaction_stream
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    edges = [None, "2024-01-08", "2024-01-15", None]
    for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):  # time order, one part each
        part = events
        if lo:
            part = part.where(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi:
            part = part.where(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/events.parquet")
        time.sleep(1.1)                                 # file times have whole seconds on some systems
    q = start_summary_changelog(summary_stream(events_transaction_stream(spark, tmp_dir, 1)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log")) == \
        _rows(member_window_summary(Inputs(spark, SF_SMALL).tx()))


def test_to_wall_time_roundtrip(spark):
    df = spark.createDataFrame([("2024-01-16 00:00:00",)], "window_start string") \
        .withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    from perkflow.functions.time import ntz_to_instant
    back = to_wall_time(df.withColumn("window_start", ntz_to_instant(F.col("window_start"))))
    assert str(back.collect()[0].window_start) == "2024-01-16 00:00:00"


def test_approx_members_stream(spark, tmp_dir):
    from perkflow.streaming.summary_stream import approx_members_stream
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    stream = approx_members_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False))
    q = (stream.writeStream.outputMode("append").format("memory").queryName("approx_members_t")
         .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
    run_to_completion(q)
    got = spark.table("approx_members_t")
    exact = member_window_summary(tx).groupBy("window_start").agg(F.countDistinct("member_id").alias("n"))
    assert got.count() == exact.count() - 1   # the last window is still open
    j = to_wall_time(got).join(exact, "window_start")
    assert j.where(F.col("approx_members") != F.col("n")).count() <= j.count() * 0.05


def test_chained_rollup_stream_equals_batch_days(spark, tmp_dir):
    from perkflow.streaming.summary_stream import rollup_stream
    tx = _truncated_tx(spark)
    _write_parts(tx, f"{tmp_dir}/in", ["2024-01-10", "2024-01-20"])
    stream = rollup_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False), "5 minutes", "1 day")
    q = start_summary_on_close(stream, f"{tmp_dir}/days", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    got = spark.read.option("basePath", f"{tmp_dir}/days").parquet(f"{tmp_dir}/days")
    want = member_window_summary(tx, "1 day")
    max_t = tx.agg(F.max("transaction_time")).collect()[0][0]
    import datetime as dt
    closed = want.where(F.col("window_end") <= F.lit(max_t - dt.timedelta(seconds=10)))
    assert got.count() > 0
    assert _rows(got) == _rows(closed)


def test_state_partitions_only_around_start(spark, tmp_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt", n_state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    run_to_completion(q)
    import os
    state_parts = os.listdir(f"{tmp_dir}/ckpt/state/0")
    assert len([p for p in state_parts if p.isdigit()]) == 3
    assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log")) == _rows(member_window_summary(tx))


def test_expirable_batches_after_compaction(spark, tmp_dir):
    tx = _truncated_tx(spark)
    _write_parts(tx, f"{tmp_dir}/in", ["2024-01-08", "2024-01-15"])
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt")
    run_to_completion(q)
    def expirable():
        found = changelog.expirable_batches(spark, f"{tmp_dir}/log", f"{tmp_dir}/table")
        return sorted(r.batch_id for r in found.collect())

    assert expirable() == []
    changelog.compact_changelog(spark, f"{tmp_dir}/log", f"{tmp_dir}/table", f"{tmp_dir}/ckpt", "2024-01-15")
    # batches 0 and 1 held only windows ending by 2024-01-15 (all compacted now);
    # batch 2 holds later, still-live windows
    assert expirable() == [0, 1]


def test_processing_time_trigger_keeps_running_until_stopped(spark, tmp_dir):
    tx = _truncated_tx(spark)
    write_ndjson(tx.coalesce(1), f"{tmp_dir}/in/part-0")
    q = start_summary_changelog(summary_stream(stream_json_transactions(spark, f"{tmp_dir}/in/*", 1, False)),
                                f"{tmp_dir}/log", f"{tmp_dir}/ckpt", trigger="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive                                   # a polling stream does not finish by itself
        assert _rows(changelog.current_summary(spark, f"{tmp_dir}/log")) == _rows(member_window_summary(tx))
    finally:
        q.stop()
    assert not q.isActive
