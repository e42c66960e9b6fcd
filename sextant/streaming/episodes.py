"""Episodes of an agent as a stream with state.

Turns come in any order and may come again.  Each episode has its own state: the turns
that wait for earlier ones, the next turn, and how many steps were taken.  A step is
written as soon as its turn is due; the first answer, or the last step allowed, ends
the episode and clears what waits.  What is left is one row that knows of the end, so
that repeated turns do not begin it anew, until a timer takes it away once the
watermark has passed the episode's last event by ``KEEP``.  A timer also takes the
turns of an episode of which one never came: then they are played in the order they
have.  So no state outlives its episode by more than that time.

Steps are written once: a micro-batch that is done again after a failure writes the
same folder again, and ``finish`` checks what was written and sums it up.

Defined cases: of several events for a turn the first to arrive counts; rows without an
id or a turn are dropped; events later than the watermark are dropped; an episode
without an answer ends with its last turn or at ``max_turns``; an empty stream writes
no steps."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sextant.functions.text import action_content, action_of

#: How late events may be, and how long an episode's state stays after its last event.
LATE, KEEP = "10 minutes", 15 * 60_000
STEPS = "id bigint, turn bigint, step int, action string, content string, done boolean, valid boolean"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Episodes(StatefulProcessor):
    """The state of one episode."""

    def __init__(self, max_turns: int, keep: int = KEEP) -> None:
        self.max_turns, self.keep = max_turns, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn bigint", "action string, content string")
        self.at = handle.getValueState("at", "next bigint, steps int, ended boolean, timer bigint, held int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call of the state is a message to the store: turns that are due at once never go there.
        due, steps, ended, timer, held = self.at.get() or (0, 0, False, 0, 0)
        last, came = 0, {}
        for r in rows:
            last = max(last, int(r.ts.timestamp() * 1000))
            if not ended and r.turn >= due and r.turn not in came and not (held and self.waiting.containsKey((r.turn,))):
                came[r.turn] = r.action, r.content
        while not ended:
            if due in came:
                turn = came.pop(due)
            elif held and self.waiting.containsKey((due,)):
                turn = self.waiting.getValue((due,))
                self.waiting.removeKey((due,))
                held -= 1
            else:
                break
            step, steps, ended = self._step(key, due, steps, turn)
            due += 1
            yield step
        if ended and held:
            self.waiting.clear()
        if ended:
            held = 0
        else:
            for turn, value in came.items():
                self.waiting.updateValue((turn,), value)
            held += len(came)
        # One timer for each episode: of its latest event.
        if last + self.keep > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = last + self.keep
            self.handle.registerTimer(timer)
        self.at.update((due, steps, ended, timer, held))

    def _step(self, key, turn: int, steps: int, value: tuple[str, str]) -> tuple[Row, int, bool]:
        action, content = value
        done = action == "answer"
        return Row(id=key[0], turn=turn, step=steps, action=action, content=content, done=done, valid=action != "invalid"), steps + 1, done or steps + 1 >= self.max_turns

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, steps, ended, _, held = self.at.get() or (0, 0, True, 0, 0)
        if held:
            for (turn,), value in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
                step, steps, ended = self._step(key, turn, steps, value)
                yield step
                if ended:
                    break
            self.waiting.clear()
        self.at.clear()

    def close(self) -> None:
        pass


def steps(turns: DataFrame, max_turns: int, response: Column, keep: int = KEEP) -> DataFrame:
    """Steps of a stream of turns (id, turn, ts and what ``response`` needs)."""
    parsed = turns.where("id IS NOT NULL AND turn IS NOT NULL").withColumn("action", action_of(response)).withColumn("content", action_content(response))
    rows = parsed.select(F.col("id").cast("bigint").alias("id"), F.col("turn").cast("bigint").alias("turn"), "ts", "action", "content").withWatermark("ts", LATE)
    return rows.groupBy("id").transformWithState(Episodes(max_turns, keep), STEPS, "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Write the steps of all that is there now below ``path``, a folder for each
    micro-batch; begun again with the same ``checkpoint`` it goes on where it stopped.
    Returns the progress of each micro-batch."""
    spark = stream.sparkSession
    put = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEPS + ", batch bigint").parquet(path).drop("batch")


def finish(written: DataFrame) -> DataFrame:
    """One row: episodes, steps, answers and a digest of what was written, whatever its
    order, and how many steps break a rule: a turn written twice, a gap in the steps, a
    step behind an answer."""
    record = F.sha2(F.to_json(F.struct("id", "turn", "step", "action", "content", "done", "valid")), 256)
    by = written.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("turns"), F.max("step").alias("last"), F.max(F.when(F.col("done"), F.col("step"))).alias("answered"), F.count_if("done").alias("answers"),
        F.sum(F.conv(F.substring(record, 1, 12), 16, 10).cast("decimal(38,0)")).alias("digest"),
    )
    broken = (F.col("n") - F.col("turns")) + F.abs(F.col("last") + 1 - F.col("n")) + F.coalesce(F.col("last") - F.col("answered"), F.lit(0))
    return by.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("steps"), F.coalesce(F.sum("answers"), F.lit(0)).alias("answers"), F.coalesce(F.sum(broken), F.lit(0)).alias("broken"), F.coalesce(F.sum("digest"), F.lit(0)).cast("string").alias("digest"))
