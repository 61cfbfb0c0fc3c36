"""Comments, statuses and votes as a stream with state, and sinks that a replay does not change.

Events are rows (audit_id, comment_id, kind, seq, target, mentions, status, user_id,
vote); seq orders the events of a comment. Kinds: `comment` (target, mentions),
`status` (status), `vote` (user_id, vote), `unvote` (user_id). Everything is decided
by the greatest seq, so events may come late, twice or in any order, and a batch
that is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UPDATE_SCHEMA = "audit_id long, comment_id long, target string, status string, visible boolean, mentions array<string>, score long, up long, down long, seq long"


class CommentState(StatefulProcessor):
    """The state of one comment: target and status, mentions, the last vote of each user, and running totals of the votes.

    A removed vote stays as 0 with its seq, so an older vote that comes again is
    not counted. Totals change by the difference of a vote, so a comment with many
    voters costs no more for each new one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.comment = handle.getValueState("comment", "target string, status string, seq long, status_seq long")
        self.totals = handle.getValueState("totals", "up long, down long, last long")
        self.mentions = handle.getMapState("mentions", "topic string", "seq long")
        self.votes = handle.getMapState("votes", "user_id long", "vote int, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        target, status, seq, status_seq = self.comment.get() if self.comment.exists() else (None, "active", -1, -1)
        up, down, last = self.totals.get() if self.totals.exists() else (0, 0, -1)
        for pdf in rows:
            for e in pdf.itertuples(index=False):
                at = int(e.seq)
                last = max(last, at)
                if e.kind == "comment":
                    if at > seq:
                        target, seq = e.target, at
                    for topic in e.mentions if e.mentions is not None else ():
                        if not self.mentions.containsKey((topic,)):
                            self.mentions.updateValue((topic,), (at,))
                elif e.kind == "status" and at > status_seq:
                    status, status_seq = e.status, at
                elif e.kind in ("vote", "unvote"):
                    user = (int(e.user_id),)
                    had, when = self.votes.getValue(user) if self.votes.containsKey(user) else (0, -1)
                    if at > when:
                        vote = int(e.vote) if e.kind == "vote" else 0
                        up, down = up + (vote > 0) - (had > 0), down + (vote < 0) - (had < 0)
                        self.votes.updateValue(user, (vote, at))
        self.comment.update((target, status, seq, status_seq))
        self.totals.update((up, down, last))
        # a comment shows once it was written, and not while it is hidden; its mentions stay whatever its status
        yield pd.DataFrame({"audit_id": [key[0]], "comment_id": [key[1]], "target": [target], "status": [status], "visible": [target is not None and status != "hidden"], "mentions": [sorted(k[0] for k in self.mentions.keys())], "score": [up - down], "up": [up], "down": [down], "seq": [last]})

    def close(self) -> None:
        pass


def comment_updates(events: DataFrame) -> DataFrame:
    """UPDATE_SCHEMA: after each batch the state of every comment that it touched; needs the RocksDB state store (see use_rocksdb)."""
    return events.groupBy("audit_id", "comment_id").transformWithStateInPandas(statefulProcessor=CommentState(), outputStructType=UPDATE_SCHEMA, outputMode="Update", timeMode="None")


#: The setting that names the state store.
STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark) -> None:
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_by_audit(stream: DataFrame, base: str, *, mode: str = "update") -> None:
    """Run a stream over all that is there; each batch is one folder, dealt by audit.

    A batch that runs again replaces its folder, so a restart from the checkpoint
    in base/state neither loses nor repeats rows; base is in the shared folder.
    """

    def sink(df: DataFrame, n: int) -> None:
        df.withColumn("audit", F.col("audit_id")).write.mode("overwrite").partitionBy("audit").parquet(f"{base}/out/batch={n}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(sink).start().awaitTermination()


def _written(spark, base: str, schema: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], f"{schema}, audit long, batch long")
    return spark.read.schema(f"{schema}, audit long, batch long").parquet(f"{base}/out")


def latest(spark, base: str, *, audit_id: int | None = None) -> DataFrame:
    """The last update of every comment, of one audit if asked, which then reads that audit's folders only."""
    rows = _written(spark, base, UPDATE_SCHEMA)
    if audit_id is not None:
        rows = rows.filter(F.col("audit") == audit_id)
    values = [c.split()[0] for c in UPDATE_SCHEMA.split(", ")][2:]
    return rows.groupBy("audit_id", "comment_id").agg(F.max_by(F.struct(*values), "batch").alias("_v")).select("audit_id", "comment_id", "_v.*")


def closed_sessions(events: DataFrame, *, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(audit_id as user, start, end, n) of sessions that the watermark has passed, for append mode: later rows are dropped and the state of closed sessions is let go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("user_id").cast("long").alias("audit_id"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
