from datetime import datetime

from marginalia.operators.maintain import net_change
from marginalia.sources.snapshots import Store
from marginalia.streaming import changes


def test_buffer_flushes_at_three():
    out = []
    buffer = changes.Buffer(out.append, lambda e: e, 3)
    for e in ("q1", "q2", "q3", "q4", "q5"):
        buffer.add(e)
    assert out == [["q1", "q2", "q3"]]
    buffer.flush()
    buffer.flush()
    assert out == [["q1", "q2", "q3"], ["q4", "q5"]]
    same = []
    keyed = changes.Buffer(same.append, lambda e: e[0], 3)
    for e in ("a1", "a2", "b1", "a3"):
        keyed.add(e)
    keyed.flush()
    assert same == [["b1", "a3"]]


def ops(spark, rows):
    return spark.createDataFrame([(i, "v", p, o, datetime(2024, 1, d), datetime(2024, 1, a)) for i, p, o, d, a in rows], changes.CHANGES)


def test_replay_equals_batch(spark, tmp_path):
    rows = [(1, "p", "add", 1, 1), (2, "p", "del", 5, 5), (3, "p", "add", 3, 9), (4, "q", "ADD", 2, 2), (5, None, "add", 2, 2)]
    (tmp_path / "in").mkdir()
    for k in range(0, 5, 2):
        ops(spark, rows[k : k + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in/change_ops.parquet"))
    streamed = changes.replay(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(streamed) == key(net_change(ops(spark, rows))) == key(streamed)
    assert {r["path"]: r["op"] for r in streamed.collect()} == {"p": "delete", "q": "add"}


def test_deltas_merge_and_replays_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), "c")
    assert changes.state(store) is None
    batches = [ops(spark, [(1, "p", "add", 1, 1), (2, "q", "add", 1, 1)]), ops(spark, [(3, "p", "del", 2, 2)]), ops(spark, [(4, "q", "del", 1, 9)])]
    for k, b in enumerate(batches[:2]):
        store.add_delta("net_changes", changes.merge_state(None, b), k)
    store.add_delta("net_changes", changes.merge_state(None, batches[1]), 1)
    key = lambda: {r["path"]: r["op"] for r in changes.state(store).collect()}
    assert len(store.deltas("net_changes")) == 2 and key() == {"p": "delete", "q": "add"}
    changes.compact(store)
    assert store.deltas("net_changes") == [] and key() == {"p": "delete", "q": "add"}
    store.add_delta("net_changes", changes.merge_state(None, batches[2]), 2)
    assert key() == {"p": "delete", "q": "delete"}
    changes.compact(store)
    changes.compact(store)
    assert key() == {"p": "delete", "q": "delete"}


def test_windows(spark, tmp_path):
    ops(spark, [(1, "p", "add", 1, 1), (2, "q", "del", 1, 1), (3, "p", "add", 9, 9)]).write.parquet(str(tmp_path / "change_ops.parquet"))
    stream = changes.counts_by_window(changes.source(spark, str(tmp_path)))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() == 3
