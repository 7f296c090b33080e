"""Keyed stream state and the vector store against plain dictionaries."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from docloom.sources.vectorstore import VectorStore
from docloom.streaming import state

EVENTS = "key long, event_id long, at_us long, status string, value double"


def expected(rows, n):
    """The last n of each key, each event once."""
    by = {}
    for key, event, at, *_ in rows:
        by.setdefault(key, {})[event] = at
    return {k: [e for e, _ in sorted(v.items(), key=lambda x: (-x[1], -x[0]))[:n]] for k, v in by.items()}


def test_last_events_shuffled_late_repeated_restarted(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, rng.randrange(40), rng.choice(["started", "completed"]), rng.choice([None, 1.5])) for i in range(200)]
    sent = rows + rng.sample(rows, 80)
    rng.shuffle(sent)
    folder, seen = tmp_path / "in", {}
    folder.mkdir()

    def drop(part, name):
        pd.DataFrame(part, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"value": float}).to_parquet(folder / name)

    def take(df, number):
        for r in df.where("age > 0").orderBy("key", "age").collect():
            seen.setdefault((r.key, number), []).append(r.event_id)

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        state.replay_then_tail(state.last_events(stream, 7), str(tmp_path / "check"), take, tail=False, mode="update")

    for i in range(3):
        drop(sent[i * 60 : (i + 1) * 60], f"{i}.parquet")
    run()
    latest = {k: v for (k, _), v in sorted(seen.items(), key=lambda x: x[0][1])}
    assert latest == expected(sent[:180], 7)
    before = set(seen)
    drop(sent[180:], "9.parquet")  # after a restart only what is new is read, on the state that was kept
    run()
    latest = {k: v for (k, _), v in sorted(seen.items(), key=lambda x: x[0][1])}
    assert latest == expected(sent, 7) == expected(rows, 7)
    assert len({b for _, b in set(seen) - before}) == 1


class Clock:
    """Handle, state and time of a processor, by hand."""

    def __init__(self):
        self.now, self.timers, self.value = 0, [], None

    getValueState = getListState = lambda self, *a: self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def advance(self, processor, ms):
        out, end = [], self.now + ms
        while due := [t for t in self.timers if t <= end]:
            self.now = min(due)
            self.timers.remove(self.now)
            out += [r for df in processor.handleExpiredTimer((1,), self, None) for r in df.itertuples(index=False)]
        self.now = end
        return out


def test_debounce_by_a_manual_clock():
    clock, p = Clock(), state.Debounced(500)
    p.init(clock)
    writes = []
    for step in range(20):  # a burst: an event each 100 ms
        assert list(p.handleInputRows((1,), iter([pd.DataFrame({"at_us": [step], "status": [f"s{step}"]})]), clock)) == []
        writes += clock.advance(p, 100)
    assert writes == []
    writes += clock.advance(p, 399)
    assert writes == []
    writes += clock.advance(p, 1)
    assert [(w.status, w.changes) for w in writes] == [("s19", 20)]
    assert clock.advance(p, 10_000) == [] and not clock.exists()
    list(p.handleInputRows((1,), iter([pd.DataFrame({"at_us": [5, 3], "status": ["late", "older"]})]), clock))
    assert [(w.status, w.changes) for w in clock.advance(p, 600)] == [("late", 2)]


def test_last_events_forget_by_a_manual_clock():
    clock, p = Clock(), state.LastEvents(3, 1000)
    p.init(clock)
    event = lambda i: iter([pd.DataFrame({"event_id": [i], "at_us": [i], "status": ["x"], "value": [None]})])
    for i in range(5):
        (out,) = p.handleInputRows((1,), event(i), clock)
        assert clock.advance(p, 900) == []
    assert out["event_id"].tolist() == [4, 3, 2] and len(clock.value) == 3
    assert [r.status for r in clock.advance(p, 100)] == ["forgotten"] and clock.value is None


def test_debounced_stream(spark, tmp_path):
    """In a running stream a key's burst is one write."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    pd.DataFrame([(1, i, i, f"s{i}", 0.0) for i in range(9)] + [(2, 1, 1, "only", 0.0)], columns=["key", "event_id", "at_us", "status", "value"]).to_parquet(folder / "a.parquet")
    stream = state.debounced(spark.readStream.schema(EVENTS).parquet(str(folder)), 300)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r.key, r.status, r.changes) for r in seen) == [(1, "s8", 9), (2, "only", 1)]


def test_vector_store_against_a_dictionary(spark, tmp_path):
    store, plain, rng = VectorStore(spark, f"file://{tmp_path}/v"), {}, random.Random(2)
    assert store.rows().count() == 0 and store.compact() == 0

    def held():
        return {r.id: (round(r.vector[0], 3), r.payload["text"], r.payload.get("k")) for r in store.rows().collect()}

    def upsert(ids):
        rows = [(i, [round(rng.random(), 3)], {"k": rng.choice([None, "v"]), "gone": None}, f"text of {i} " + "x" * 600) for i in ids]
        store.upsert(spark.createDataFrame(rows, "id string, vector array<double>, metadata map<string,string>, text string"))
        plain.update({i: (v[0], t[:500], m["k"]) for i, v, m, t in rows})

    upsert("abcdef")
    upsert("cdgh")
    assert held() == plain
    old = store.delete(spark.createDataFrame([("a",), ("g",), ("unknown",)], "id string"))
    for i in "ag":
        plain.pop(i)
    assert held() == plain
    assert store.compact() == old and held() == plain
    upsert("ab")
    assert held() == plain and {r.id for r in store.rows(old).collect()} == set(plain) - {"a"}
    # a writer that died leaves a version that does not count, and its number is not used again
    number = store._claim()
    spark.createDataFrame([("z", number, False, [1.0], {"text": "half"})], "id string, version long, deleted boolean, vector array<float>, payload map<string,string>").write.parquet(f"file://{tmp_path}/v/delta-{number}")
    (tmp_path / "v" / f"delta-{number}" / "_SUCCESS").unlink()
    assert held() == plain
    upsert("k")
    assert held() == plain and max(v for v, _ in store._versions()) == number + 1
    store.compact()
    store.vacuum()
    assert held() == plain and len(store._versions()) == 1
    store.replace(spark.createDataFrame([("n", [1.0], {"k": "w"}, None)], "id string, vector array<double>, metadata map<string,string>, text string"))
    assert held() == {"n": (1.0, "", "w")}
    assert store.rows().where(F.map_contains_key("payload", "gone")).count() == 0
