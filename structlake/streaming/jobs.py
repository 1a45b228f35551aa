"""Structured Streaming jobs over arriving records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..shipping import ship
from ..sources.shelx import parse_headers


def stream_record_ingest(spark: SparkSession, inbox: str, batch_files: int = 100) -> DataFrame:
    """A stream of records from files that arrive in ``inbox``, each read once."""
    rows = spark.readStream.format("text").option("lineSep", "\nEND\n").option("maxFilesPerTrigger", batch_files).load(inbox)
    texts = rows.select(F.col("_metadata.file_path").alias("fname"), F.regexp_replace("value", r"\nEND\s*$", "").alias("text"))
    return parse_headers(texts)


def route_good_bad(stream: DataFrame, good: Column, good_path: str, bad_path: str, checkpoint: str, nonstop: bool = False) -> StreamingQuery:
    """Rows that meet ``good`` to one folder, the others (null too) to another."""

    def batch(df: DataFrame, epoch: int) -> None:
        tagged = df.withColumn("_ok", F.coalesce(good, F.lit(False))).persist()
        # a folder per epoch, overwritten when the epoch is run again
        tagged.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{good_path}/epoch={epoch}")
        tagged.filter("not _ok").drop("_ok").write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch}")
        tagged.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="5 seconds") if nonstop else writer.trigger(availableNow=True)).start()


def stream_counts(stream: DataFrame, by: str) -> DataFrame:
    """Running counts per key (update or complete mode)."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def stream_completion(counts: DataFrame, expected: DataFrame, by: str, threshold: float = 0.98) -> DataFrame:
    """Counts with ``done`` once n / expected passes the threshold."""
    return counts.join(expected, by).withColumn("done", F.col("n") / F.col("expected") > threshold)


def stream_generation_progress(stream: DataFrame, gen: str, done: Column, out: str, checkpoint: str, nonstop: bool = False) -> StreamingQuery:
    """gen, n_structures, n_done, epoch: a generation's counts whenever they change.

    Runs in update mode; each epoch writes the generations that it touched to a folder
    of its own, overwritten when the epoch is run again.
    """
    counts = stream.groupBy(gen).agg(F.count("*").alias("n_structures"), F.count_if(done).alias("n_done"))

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="5 seconds") if nonstop else writer.trigger(availableNow=True)).start()


def latest_progress(spark: SparkSession, out: str, gen: str) -> DataFrame:
    """gen, n_structures, n_done: the newest counts that ``stream_generation_progress`` wrote."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    newest = rows.groupBy(gen).agg(F.max_by(F.struct("n_structures", "n_done"), "epoch").alias("_c"))
    return newest.select(gen, "_c.n_structures", "_c.n_done")


#: Groups of keys that a stream's state is dealt to.
KEY_GROUPS = 128


def stream_energy_admission(stream: DataFrame, key: str, energy: str, time: str, label: str, threshold: float, delay: str = "1 hour", key_groups: int | None = None) -> DataFrame:
    """key, label, energy, admitted: against each key's running least energy, in order of time, then label.

    A record lowers the least energy of its key, and is admitted when within
    ``threshold`` of it, so a key's first energy is. A record without an energy is not
    admitted and lowers nothing. Records wait in state until the watermark,
    ``delay`` behind the latest time, has passed theirs, so the files they come in may be in any
    order within it. Later ones (and those without a time) are late: Spark drops them and
    counts them in the progress (numRowsDroppedByWatermark). The last records come out
    when later ones, of any key, move the watermark on. ``time`` is a timestamp.

    Keys share ``key_groups`` states (KEY_GROUPS), so a batch has a call for each of these, not for
    each key. What waits for a group has to fit a task; a stream keeps its number of groups.
    """
    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)

    def admit(group, frames: Iterator, state):
        import numpy as np
        import pandas as pd

        known, least, keys, times, labels, energies = state.get if state.exists else ([], [], [], [], [], [])
        columns = lambda k, t, l, e: pd.DataFrame({"k": k, "t": np.array(t, dtype=np.int64), "l": l, "e": np.array(e, dtype=float)})  # noqa: E731, E741
        waiting = [columns(keys, times, labels, energies)]
        if not state.hasTimedOut:
            waiting += [columns(f[key], f["_t"], f[label], f[energy]) for f in frames if len(f)]
        rows = pd.concat([w for w in waiting if len(w)] or waiting, ignore_index=True).sort_values(["t", "l"], kind="stable")
        watermark = state.getCurrentWatermarkMs()
        past = rows["t"] <= watermark * 1000
        out, rows = rows[past], rows[~past]
        values = lambda k: [None] * len(k) if group[0] < 0 else k.tolist()
        # the least energies so far stand before the records of their keys
        codes, found = pd.factorize(np.array(known + values(out["k"]), dtype=object), use_na_sentinel=False)
        energies = pd.Series(np.append(least, out["e"].to_numpy()))
        # nan lowers nothing
        run = energies.groupby(codes).cummin().to_numpy()[len(known) :]
        if len(rows):
            state.setTimeoutTimestamp(max(int(rows["t"].iloc[0]) // 1000, watermark) + 1)
        state.update((values(found), energies.groupby(codes).min().tolist(), values(rows["k"]), rows["t"].tolist(), rows["l"].tolist(), rows["e"].tolist()))
        yield pd.DataFrame({key: values(out["k"]), label: out["l"], energy: out["e"], "admitted": out["e"].to_numpy() <= run + threshold})

    schema = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, `{energy}` double, admitted boolean"
    kept = f"known array<{kinds[key]}>, least array<double>, keys array<{kinds[key]}>, times array<long>, labels array<{kinds[label]}>, energies array<double>"
    # records without a key have a group of their own, so that no other's keys are mixed with nulls
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(key_groups or KEY_GROUPS))).cast("int")
    timed = stream.select(group.alias("_group"), key, label, F.col(energy).cast("double").alias(energy), F.col(time), F.unix_micros(time).alias("_t")).withWatermark(time, delay)
    return timed.groupBy("_group").applyInPandasWithState(admit, schema, kept, "append", "EventTimeTimeout")


def energy_admission_batch(rows: DataFrame, key: str, energy: str, time: str, label: str, threshold: float) -> DataFrame:
    """The same rule over a stored table, by a running minimum; rows without a time come first."""
    from pyspark.sql import Window

    run = F.min(energy).over(Window.partitionBy(key).orderBy(time, label).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, label, F.col(energy).cast("double").alias(energy), F.coalesce(F.col(energy) <= run + threshold, F.lit(False)).alias("admitted"))
