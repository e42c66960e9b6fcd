"""Episodes as a stream with state: order, repeats, gaps, restart, and what stays."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sextant.session import scratch
from sextant.streaming import episodes

SCHEMA = "id bigint, turn bigint, response string, ts timestamp"
START = datetime(2024, 1, 1)


def turns():
    """Each episode's turns: (id, turn, response)."""
    out = []
    for i in range(40):
        for t in range(5):
            out.append((i, t, "<answer>a</answer>" if i % 4 == 1 and t == 2 or i % 4 == 2 else f"<search>q{t}</search>" if i % 3 else "nothing"))
    return [x for x in out if not (x[0] % 10 == 7 and x[1] == 1)]  # a turn that never comes


def played(rows, max_turns=4):
    out = []
    for i in sorted({r[0] for r in rows}):
        for step, (_, t, text) in enumerate(sorted(r for r in rows if r[0] == i)[:max_turns]):
            action = "answer" if "<answer>" in text else "search" if "<search>" in text else "invalid"
            out.append((i, t, step, action, action == "answer"))
            if action == "answer":
                break
    return sorted(out)


def events(order=3):
    """The turns in time, a little out of order, and some twice."""
    rng = random.Random(order)
    rows = [(i, t, x, START + timedelta(minutes=i, seconds=10 * t)) for i, t, x in turns()]
    rows += [rows[k] for k in rng.sample(range(len(rows)), 40)]
    return sorted(rows, key=lambda r: (r[3] + timedelta(seconds=rng.randint(0, 120)), r[1]))


def test_stream_restarts_and_clears_its_state(spark):
    rows = [*events(), (None, 0, "x", START), (1, None, "x", START)]
    at = scratch(spark, "episodes")
    last = spark.createDataFrame([(99, 0, "<answer>z</answer>", START + timedelta(days=1)), (98, 0, "<answer>z</answer>", START + timedelta(days=2))], SCHEMA)
    parts = [rows[k : k + 45] for k in range(0, len(rows), 45)]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    progress = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if k in (1, len(parts) - 1):  # stopped in the middle, and begun again
            progress += episodes.run(episodes.steps(stream(), 4, F.col("response")), f"{at}/out", f"{at}/state")
    for row in last.collect():
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        progress += episodes.run(episodes.steps(stream(), 4, F.col("response")), f"{at}/out", f"{at}/state")
    got = episodes.read(spark, f"{at}/out").where("id < 90")
    assert sorted((r["id"], r["turn"], r["step"], r["action"], r["done"]) for r in got.collect()) == played(turns())
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] < 10 < max(held)  # of episodes that are over nothing stays
    summary = episodes.finish(got).collect()[0]
    assert (summary["episodes"], summary["steps"], summary["broken"]) == (40, len(played(turns())), 0)
    again = episodes.finish(got.repartition(7).orderBy(F.rand())).collect()[0]
    assert again["digest"] == summary["digest"]
    assert episodes.finish(got.unionByName(got.limit(1))).collect()[0]["broken"] > 0


class Calls:
    """State of one key that counts its calls."""

    def __init__(self):
        self.n, self.map, self.value = 0, {}, None

    def __getattr__(self, name):
        def call(*x):
            self.n += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = x[0]
            return {"containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "removeKey": self.map.pop, "clear": self.map.clear, "updateValue": self.map.__setitem__, "exists": lambda: self.value is not None}.get(name, lambda *_: None)(*x)

        return call

    def getMapState(self, *_):
        return self

    getValueState = getMapState


def test_turns_that_are_due_do_not_go_through_the_state():
    from pyspark.sql import Row

    state, one = Calls(), episodes.Episodes(4)
    one.init(state)
    row = lambda t: Row(turn=t, action="search", content=f"q{t}", ts=START)
    assert [s["turn"] for s in one.handleInputRows((1,), iter([row(1), row(0), row(3), row(1)]), None)] == [0, 1]
    assert state.map == {(3,): ("search", "q3")} and state.n <= 4
    assert [(s["turn"], s["content"]) for s in one.handleInputRows((1,), iter([row(2), row(3)]), None)] == [(2, "q2"), (3, "q3")] and not state.map
