"""How often the deciders call their state: every call is a round trip to the state store."""

import pandas as pd
import pytest

from tracewell.streaming import processors


class Counted:
    """Map and value states in memory."""

    def __init__(self):
        self.calls, self.maps = 0, {}

    def getMapState(self, name, *_):
        return Part(self, self.maps.setdefault(name, {}))

    getValueState = getMapState


class Part:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def __getattribute__(self, name):
        if name in ("store", "rows"):
            return object.__getattribute__(self, name)
        self.store.calls += 1
        rows = self.rows
        return {
            "getValue": rows.get, "updateValue": rows.__setitem__, "removeKey": rows.pop, "containsKey": rows.__contains__,
            "iterator": lambda: iter(list(rows.items())), "keys": lambda: iter(list(rows)), "exists": lambda: None in rows,
            "get": lambda: rows[None], "update": lambda v: rows.__setitem__(None, v),
        }[name]


def run(decider, parts):
    store = Counted()
    decider.init(store)
    out = [tuple(r) for p in parts for frame in decider.handleInputRows(("r",), iter([p]), None) for r in frame.itertuples(index=False)]
    return store, sorted(out)


@pytest.mark.parametrize("turns", [1, 3])
def test_edges_and_marks_in_blocks(turns):
    n = 900
    columns = ["kind", "sample", "code", "source", "clock", "edge_seq"]
    edges = [("edge", 10 * k, None, 0, 10 * k - 5, k) for k in range(1, n + 1)] + [("event", 3004, None, 0, 3004, 300), ("event", 3006, None, 0, 3006, 300)]
    marks = [("mark", 0, None, 1, None, k) for k in range(1, n + 1)] + [("onset", 1, 7, 1, None, 300), ("onset", 2, 6, 1, None, 800)]
    ends = [("clock", None, None, s, 1 << 40, None) for s in (0, 1)]
    frames = [pd.DataFrame(rows, columns=columns).astype({"edge_seq": "Int64", "sample": "Int64", "clock": "float"}) for rows in (marks, edges, ends)]
    parts = frames if turns == 3 else [pd.concat(frames)]
    store, got = run(processors.AlignedDecider(0, 20, 2, 100_000, sources=2), parts)
    assert [(r[1], r[2], r[3]) for r in got] == [(3001, 7, "TRIGGER"), (8002, 6, "NO_TRIGGER")]
    assert not store.maps["waiting"] and not store.maps["anchors"] and not store.maps["recent"]
    assert store.calls < 120


def test_what_time_passes_at_once_is_not_written():
    rows = [("event", 5 * k, 0, 0, 5 * k) for k in range(400)] + [("anchor", 100, 3, 0, 100), ("clock", 10_000, 0, 0, 10_000)]
    frame = pd.DataFrame(rows, columns=["kind", "sample", "code", "source", "clock"])
    store, got = run(processors.WindowDecider(0, 12, 3, 20), [frame])
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [(100, "TRIGGER", 3, 110)]
    assert store.calls < 30 and not store.maps["recent"]
