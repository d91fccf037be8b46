"""The course stages as streams: order, failures, late and missing items, restarts."""

from datetime import datetime, timedelta

import pandas as pd

from docloom.streaming import stages

SCHEMA = "course string, item long, ts timestamp, error string"
T0 = datetime(2024, 1, 1)


def rows(spark, path, n, *some):
    made = [(c, i, T0 + timedelta(minutes=m), e) for c, i, m, e in some]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")


def run(spark, tmp_path, name, flow):
    a, b = (spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{x}/*") for x in ("t", "c"))
    out = flow(a, b)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")


def test_parts_in_order_over_restarts(spark, tmp_path):
    plan = spark.createDataFrame([(c, i, i // 2) for c in "ab" for i in range(6)], "course string, item long, part long")
    flow = lambda a, b: stages.exported_parts(a, b, plan, "2 hours", "30 minutes")
    rows(spark, f"{tmp_path}/t", 0, *[("a", i, i, None) for i in range(6)], *[("b", i, i, "no audio" if i == 3 else "") for i in range(6)])
    rows(spark, f"{tmp_path}/c", 0, ("a", 1, 10, None), ("a", 2, 11, None), ("a", 3, 12, None), *[("b", i, 20, None) for i in range(6)])
    first = {(r.course, r.part) for r in run(spark, tmp_path, "out", flow).collect()}
    assert first == {("b", 0)}  # a's first item isn't compressed, b's fourth failed
    rows(spark, f"{tmp_path}/c", 1, ("a", 0, 40, None), ("a", 0, 41, None), ("a", 4, 42, None))
    got = [(r.course, r.part) for r in run(spark, tmp_path, "out", flow).collect()]
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0)]  # each once, and a's last part still lacks an item


def test_late_and_missing_stages(spark, tmp_path):
    rows(spark, f"{tmp_path}/t", 0, ("a", 1, 0, None), ("a", 2, 0, None), ("a", 3, 5, None))
    rows(spark, f"{tmp_path}/c", 0, ("a", 1, 30, None), ("a", 3, 400, None))  # the third comes over two hours later
    flow = lambda a, b: stages.stalled(a, b, "2 hours", "30 minutes")
    run(spark, tmp_path, "late", flow)
    for n in (1, 2):  # what moves the watermarks on
        rows(spark, f"{tmp_path}/t", n, ("z", n, 1000 * n, None))
        rows(spark, f"{tmp_path}/c", n, ("z", n, 1000 * n + 1, None))
        out = run(spark, tmp_path, "late", flow)
    assert {(r.course, r.item) for r in out.collect()} == {("a", 2), ("a", 3)}


class Calls(dict):
    """A map state that counts what is asked of it."""

    calls = 0

    def containsKey(self, k):  # noqa: N802, N803
        self.calls += 1
        return k in self

    def getValue(self, k):  # noqa: N802, N803
        self.calls += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802, N803
        self.calls += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802, N803
        self.calls += 1
        del self[k]

    def iterator(self):
        self.calls += len(self)
        return iter(list(self.items()))


class OneValue:
    held = None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


def test_a_course_of_many_parts_asks_its_state_a_few_times_a_part():
    """Before, each part that came out went through all the items that waited."""
    made, n = Calls(), 2000
    handle = type("Handle", (), {"getMapState": lambda self, *a: made, "getValueState": lambda self, *a: OneValue()})()
    p = stages.WholeParts()
    p.init(handle)
    every = pd.DataFrame({"part": [i // 4 for i in range(4 * n)], "item": range(4 * n), "items_of_part": 4})
    first = every[every["item"] % 4 < 3]
    assert len(pd.concat(p.handleInputRows(("c",), iter([first]), None))) == 0
    out = pd.concat(p.handleInputRows(("c",), iter([every[every["item"] % 4 == 3], first]), None))
    assert out.part.tolist() == list(range(n)) and not made
    assert made.calls < 10 * n
