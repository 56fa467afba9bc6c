"""Custom state: differential results and silent nodes.

State handlers and the processors are built inside functions and travel to the
workers by value. They need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``, see ``jobs.ROCKSDB``), which
spills to disk and checkpoints changes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetscope.operators.registry import has_id

#: Groups that a bucket of ``split_stream`` is dealt into, and ids that it gathers before it hands them to the state.
GROUPS, PIECE = 64, 1 << 14
DIFF_SCHEMA = "node_id string, query_name string, execution_no bigint, row string, action string"


def run_records(runs: DataFrame) -> DataFrame:
    """One record a row and one at the end of each run, out of one record a run with an array of ``rows``."""
    keys = ["node_id", "query_name", "execution_no", "status_code"]
    times = ["ts"] if "ts" in runs.columns else []
    part = F.struct(F.lit(None).cast("string").alias("row"), F.lit(True).alias("ended"))
    rows = F.transform(F.coalesce("rows", F.array().cast("array<string>")), lambda r: F.struct(r.alias("row"), F.lit(False).alias("ended")))
    return runs.select(*keys, *times, F.explode(F.concat(rows, F.array(part))).alias("__r")).select(*keys, *times, "__r.row", "__r.ended")


def differ(limit: int):
    """The state handler of ``differential_stream``; with a ``limit``, open runs end so many milliseconds after their newest record."""
    from pyspark.sql.streaming import StatefulProcessor

    class Differ(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.live = handle.getMapState("live", "row string", "run bigint")
            self.fresh = handle.getMapState("fresh", "row string", "times bigint")
            self.marks = handle.getMapState("marks", "row string", "run bigint")
            # Last settled run, the open one, rows in ``live``, those of them that the open run has, and when it is given up.
            self.meta = handle.getValueState("meta", "closed bigint, open bigint, size bigint, again bigint, until bigint")

        def start(self):
            held = self.meta.get() if self.meta.exists() else (None, None, 0, 0, 0)
            self.closed, self.open, self.size, self.again, self.until = held
            self.kept_before = self.open  # what is in state about this run, beside what this call gathers
            self.new, self.seen = {}, set()

        def give_up(self):
            if self.kept_before is not None:
                self.fresh.clear()
                self.marks.clear()
            self.open, self.kept_before, self.again = None, None, 0
            self.new, self.seen = {}, set()

        def take(self, values):
            for row, times in values.items():
                if row in self.new or row in self.seen:
                    known = row in self.seen
                else:
                    known = self.live.containsKey((row,))
                if not known:
                    self.new[row] = self.new.get(row, 0) + times
                elif row not in self.seen and not (self.kept_before is not None and self.marks.containsKey((row,))):
                    self.seen.add(row)
                    self.again += 1

        def settle(self, run):
            """The changes that the open run makes, now that it is whole."""
            new = dict(self.new)
            if self.kept_before is not None:
                for (row,), (times,) in self.fresh.iterator():
                    new[row] = new.get(row, 0) + times
            out = []
            if self.closed is None:
                out += [(run, row, "SNAPSHOT") for row, times in new.items() for _ in range(times)]
            else:
                out += [(run, row, "ADDED") for row in new]
                if self.again < self.size:
                    for (row,) in list(self.live.keys()):
                        if row not in self.seen and not (self.kept_before is not None and self.marks.containsKey((row,))):
                            out.append((run, row, "REMOVED"))
                            self.live.removeKey((row,))
            for row in new:
                self.live.updateValue((row,), (run,))
            self.size = (self.again if self.closed is not None else 0) + len(new)
            self.give_up()
            self.closed = run
            return out

        def finish(self):
            """Keep what an open run has so far."""
            if self.open is not None:
                for row, times in self.new.items():
                    before = self.fresh.getValue((row,)) if self.kept_before is not None else None
                    self.fresh.updateValue((row,), (times + (before[0] if before else 0),))
                for row in self.seen:
                    self.marks.updateValue((row,), (self.open,))
                if limit:
                    self.handle.registerTimer(self.until)
            self.meta.update((self.closed, self.open, self.size, self.again, self.until))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            pdf = pd.concat(list(rows), ignore_index=True)
            self.start()
            out = []
            for run, part in pdf.groupby("execution_no", sort=True):
                run, ended = int(run), bool(part["ended"].any())
                if (self.closed is not None and run <= self.closed) or (self.open is not None and run < self.open):
                    if ended and run != self.closed and key[2] == 0:
                        out.append((run, None, "LATE"))
                    continue
                if self.open is not None and run > self.open:
                    self.give_up()
                self.open = run
                self.take(part.loc[~part["ended"].astype(bool), "row"].value_counts(sort=False).to_dict())
                self.until = max(int(part["ms"].max()) + limit, self.until or 0)
                if ended:
                    if int(part.loc[part["ended"].astype(bool), "status"].iloc[0]) == 0:
                        out += self.settle(run)
                    else:
                        self.give_up()
            self.finish()
            yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["node_id", "query_name", "execution_no", "row", "action"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            self.start()
            if self.open is not None and expiredTimerInfo.getExpiryTimeInMs() >= self.until:
                self.give_up()
                self.finish()
            yield pd.DataFrame([], columns=["node_id", "query_name", "execution_no", "row", "action"]).astype({"execution_no": "int64"})

        def close(self):
            pass

    return Differ()


def differential_stream(records: DataFrame, buckets: int = 8, timeout_seconds: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Streaming form of ``diff.differential``, fed row by row.

    ``records``: node_id, query_name, execution_no, ``row`` (canonical text),
    ``ended`` and status_code. A run's rows may come over several micro-batches;
    its last record has ``ended`` set, no row, and the run's status. Only that
    record settles a run, so a run of any size, also an empty one, is never in one
    record. A run that failed changes nothing. An older run than the last
    settled one gives one LATE row when it ends; a run recorded again gives nothing.
    Runs of a (node, query) come one after the other: a record of a newer run
    gives up one that never ended. With
    ``timeout_seconds`` (and a ``ts`` column) so does the watermark, that long
    after the run's newest record.

    Whether a row changed does not depend on other rows, so rows are spread over
    ``buckets`` by hash, and a chatty (node, query) is not one task; only end
    records visit every bucket. State per bucket: the rows of the last settled run and
    their number. A row costs one lookup. Rows that are new or seen in a run
    that stays open are written; all rows are gone through only in a bucket
    where some of them are missing, which the count tells beforehand.
    """
    timed = timeout_seconds is not None
    if timed:
        # The time travels as a number: Spark would drop late rows of a column with a watermark, and here they are data.
        records = records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    spread = records.select(
        F.col("node_id").cast("string").alias("node_id"), "query_name", F.col("execution_no").cast("bigint").alias("execution_no"),
        F.explode(F.when(F.col("ended"), every).otherwise(own)).alias("bucket"), "row", "ended",
        F.coalesce(F.col("status_code").cast("bigint"), F.lit(0)).alias("status"),
        (F.unix_millis("ts") if timed else F.lit(0).cast("bigint")).alias("ms"))
    return spread.groupBy("node_id", "query_name", "bucket").transformWithStateInPandas(
        statefulProcessor=differ((timeout_seconds or 0) * 1000), outputStructType=DIFF_SCHEMA, outputMode="Append", timeMode="EventTime" if timed else "None")


def interval_ms(spark: SparkSession, text: str) -> int:
    """Milliseconds of an interval like ``10 minutes``."""
    return spark.sql(f"select unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {text})").first()[0]


def split_stream(df: DataFrame, delay: str, key: str = "sequence_id", ts: str = "ts", buckets: int = 32) -> DataFrame:
    """Every row of a stream once, with ``outcome``: kept, duplicate or late.

    Late is what lies behind the watermark (the newest time of earlier
    micro-batches less ``delay``); such rows are not compared with others, as the ids
    of their time are no longer held. A row whose id was kept at most ``delay`` ago is a
    duplicate. Rows without an id or without a time are kept. Rows of one
    micro-batch count in the order of their times.

    One read of the source serves all sinks: write it partitioned by
    ``outcome``, or filter in ``foreachBatch``. Ids are spread over ``buckets``; each
    holds its ids and, by slices of time, which ones to forget when the watermark
    has passed a slice, so forgetting reads what goes and nothing else. A slice is
    kept in pieces of at most ``PIECE`` ids, however many it has. Spark's Python worker
    gathers all rows that come out for one key of a micro-batch before it sends
    them; so a bucket is ``GROUPS`` keys, and a worker holds the rows of one of them.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import StringType, StructField, StructType

    columns, named = df.columns, has_id(df, key)
    # The watermark's column stays behind, so that Spark lets late rows through; the time travels as a number.
    sent = df.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", delay).select(
        *columns, F.unix_millis("__t").alias("__ms"), F.when(named, F.col(key).cast("string")).alias("__id"),
        F.pmod(F.when(named, F.xxhash64(key)).otherwise(F.xxhash64(*columns)), F.lit(buckets * GROUPS)).cast("int").alias("__group"))
    kept_ms = interval_ms(df.sparkSession, delay)
    width, piece = max(kept_ms // 8, 1), PIECE
    result = Row(*columns, "outcome")

    class Splitter(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.ids = handle.getMapState("ids", "id string", "until bigint")
            self.pieces = handle.getMapState("pieces", "slice bigint, piece bigint", "ids array<string>")
            self.counts = handle.getMapState("counts", "slice bigint", "pieces bigint")

        def keep(self, added):
            for at, ids in added.items():
                n = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
                self.pieces.updateValue((at, n), (ids,))
                self.counts.updateValue((at,), (n + 1,))
                self.handle.registerTimer((at + 1) * width)

        def handleInputRows(self, key, rows, timerValues):
            passed, added, size = timerValues.getCurrentWatermarkInMs(), {}, 0
            for row in rows:
                ms, ident, outcome = row["__ms"], row["__id"], "kept"
                if ms is not None and ms <= passed:
                    outcome = "late"
                elif ms is not None and ident is not None:
                    if self.ids.containsKey((ident,)):
                        outcome = "duplicate"
                    else:
                        until = ms + kept_ms
                        self.ids.updateValue((ident,), (until,))
                        added.setdefault(until // width, []).append(ident)
                        size += 1
                        if size >= piece:
                            self.keep(added)
                            added, size = {}, 0
                yield result(*[row[c] for c in columns], outcome)
            self.keep(added)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at = expiredTimerInfo.getExpiryTimeInMs() // width - 1
            if self.counts.containsKey((at,)):
                for n in range(self.counts.getValue((at,))[0]):
                    for ident in self.pieces.getValue((at, n))[0]:
                        self.ids.removeKey((ident,))
                    self.pieces.removeKey((at, n))
                self.counts.removeKey((at,))
            return iter(())

        def close(self):
            pass

    return sent.groupBy("__group").transformWithState(
        statefulProcessor=Splitter(), outputStructType=StructType([*df.schema.fields, StructField("outcome", StringType())]),
        outputMode="Append", timeMode="EventTime")


def offline_stream(df: DataFrame, timeout_seconds: int, delay: str = "1 minute", ts: str = "recorded_at") -> DataFrame:
    """Nodes that fell silent: one row when event time passes a node's last heartbeat by the timeout.

    Needs columns node_id and ``ts``. State per node is one time and one timer.
    Heartbeats are thinned to the newest per node in each Arrow batch before the
    shuffle, so a node that reports without pause costs no more than others.
    """
    from pyspark.sql.streaming import StatefulProcessor

    limit_ms = timeout_seconds * 1000

    class Silence(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            newest = max(int(pdf["ms"].max()) for pdf in rows)
            known = self.last.get()[0] if self.last.exists() else -1
            if newest > known:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.last.update((newest,))
                self.handle.registerTimer(newest + limit_ms)
            yield pd.DataFrame({"node_id": [], "last_seen_ms": [], "offline_ms": []}).astype(
                {"node_id": "object", "last_seen_ms": "int64", "offline_ms": "int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            seen = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({"node_id": [key[0]], "last_seen_ms": [seen], "offline_ms": [seen + limit_ms]})

        def close(self):
            pass

    def newest(batches):
        for pdf in batches:
            yield pdf.groupby("node_id", as_index=False)["t"].max()

    beats = df.select(F.col("node_id").cast("string").alias("node_id"), F.col(ts).cast("timestamp").alias("t"))
    thinned = beats.filter("node_id is not null and t is not null").mapInPandas(newest, "node_id string, t timestamp")
    marked = thinned.withWatermark("t", delay).select("node_id", "t", F.unix_millis("t").alias("ms"))
    return marked.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=Silence(), outputStructType="node_id string, last_seen_ms bigint, offline_ms bigint",
        outputMode="Append", timeMode="EventTime")
