"""Incremental and stateful forms: exposure windows, gap sampling, upserts of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.shipping import ship_package

#: An exposure closes at this many touches, or after this time, whichever comes first.
MAX_TOUCHES, MAX_MS = 8, 30 * 60 * 1000
EXPOSURES = "sid long, opened long, closed long, touches int, reason string"


class Exposure:
    """One session's open window: a row may close it by time, then touches it, or opens a new one."""

    def __init__(self, opened: int | None = None, touches: int = 0):
        self.opened, self.touches = opened, touches

    def take(self, ts: int, opens: bool) -> list[tuple[int, int, int, str]]:
        closed = self.expire(ts)
        if self.opened is None:
            if opens:
                self.opened, self.touches = ts, 0
            return closed
        self.touches += 1
        if self.touches >= MAX_TOUCHES:
            closed.append((self.opened, ts, self.touches, "touches"))
            self.opened = None
        return closed

    def expire(self, now: int) -> list[tuple[int, int, int, str]]:
        if self.opened is None or now - self.opened < MAX_MS:
            return []
        out = [(self.opened, self.opened + MAX_MS, self.touches, "time")]
        self.opened = None
        return out

    def finish(self) -> list[tuple[int, int, int, str]]:
        return [] if self.opened is None else [(self.opened, self.opened + MAX_MS, self.touches, "end")]


def _frame(sid, rows: list) -> pd.DataFrame:
    return pd.DataFrame([(sid, *r[:1], r[1], r[2], r[3]) for r in rows], columns=["sid", "opened", "closed", "touches", "reason"])


def exposure_windows(events: DataFrame, opening: str) -> DataFrame:
    """All windows of a finished log (sid, ord, ts, name): one row each, by append order within a session.

    Sessions come sorted and in batches; only the open window of the session at hand is kept.
    """
    ship_package(events.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, state = None, Exposure()
        for rows in frames:
            out = []
            for r in rows.itertuples(index=False):
                if r.sid != sid:
                    out += [(sid, *w) for w in state.finish()]
                    sid, state = r.sid, Exposure()
                out += [(sid, *w) for w in state.take(int(r.ts), r.opens)]
            yield pd.DataFrame(out, columns=["sid", "opened", "closed", "touches", "reason"])
        yield _frame(sid, state.finish())

    rows = events.select("sid", "ts", (F.col("name") == opening).alias("opens"), "ord")
    return rows.repartition("sid").sortWithinPartitions("sid", "ord").mapInPandas(run, EXPOSURES)


def stream_exposure_windows(events: DataFrame, opening: str) -> DataFrame:
    """The same over a stream; rows of a session come in append order, and a window left open closes by processing time."""
    ship_package(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Exposure(*(state.get if state.exists else (None, 0)))
        if state.hasTimedOut:
            out = held.finish()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ord")
            out = [w for r in rows.itertuples() for w in held.take(int(r.ts), r.name == opening)]
            state.update((held.opened, held.touches))
            state.setTimeoutDuration(MAX_MS)
        yield _frame(key[0], out)

    return events.groupBy("sid").applyInPandasWithState(step, EXPOSURES, "opened long, touches int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def spaced(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Times at least gap_ms after the last time kept, by key: one pass over sorted times, with the last kept time as its only state."""
    ship_package(events.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, 0
        for rows in frames:
            kept = []
            for k, ts in zip(rows[key], rows["ts"], strict=True):
                if k != own or ts - last >= gap_ms:
                    own, last = k, ts
                    kept.append((k, ts))
            yield pd.DataFrame(kept, columns=[key, "ts"])

    rows = events.select(key, "ts")
    return rows.repartition(key).sortWithinPartitions(key, "ts").mapInPandas(run, rows.schema)


def upsert_files(current: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """Replaces all rows of the batch's keys: the rest of the table and the batch."""
    return current.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batches whose list of versions is whole."""
    at, files = _at(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_at(spark, f"{path}/versions/{n}/_SUCCESS")[0]))


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch wrote each bucket last; a row for each bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/versions/{number}").collect()}


def followed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as the last whole batch left it."""
    numbers = _numbers(spark, path)
    known = _versions(spark, path, numbers[-1]) if numbers else {}
    folders = [f"{path}/data/{v}/_bucket={b}" for b, v in sorted(known.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def follow(stream: DataFrame, path: str, checkpoint: str, key: str = "path", *, buckets: int = 64):
    """Keeps a table of files up to date from a stream of rows, see followed.

    Rows are dealt to buckets by their key, and a micro-batch writes only the buckets it
    touches anew, under its number; a list of the buckets' versions makes the batch count, so
    a batch that comes again has the same effect. Versions that neither the last list nor
    the one before names are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.withColumn("_at", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(F.struct(*batch.columns), "_at").alias("row")).select("row.*")  # the last row of each key
        latest = latest.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r["_bucket"] for r in latest.select("_bucket").distinct().collect()]
        before = [n for n in _numbers(spark, path) if n < number]
        known = _versions(spark, path, before[-1]) if before else {}
        old = [f"{path}/data/{known[b]}/_bucket={b}" for b in touched if b in known]
        if touched:
            rows = latest
            if old:
                held = spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
                rows = upsert_files(held, latest, key)
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/{number}")
            versions = known | dict.fromkeys(touched, number)
            spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")
            named = set(versions.values()) | set(known.values())
            for folder, kept in ((f"{path}/data", named), (f"{path}/versions", {number, *before[-1:]})):
                at, files = _at(spark, folder)
                for name in [s.getPath().getName() for s in files.listStatus(at)]:
                    if name.isdigit() and int(name) < number and int(name) not in kept:
                        files.delete(_at(spark, f"{folder}/{name}")[0], True)
        latest.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
