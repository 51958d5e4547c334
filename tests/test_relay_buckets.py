"""The relay over buckets of requests: state by bucket, ends by request."""

import datetime as dt

import pandas as pd

from tests.test_relay import events_of, follow, frame, token
from textforge.operators import relay as R
from textforge.streaming import buckets as BK
from textforge.streaming import relay as SR

T0 = dt.datetime(2024, 1, 1)


def test_open_requests_share_the_state_of_a_bucket(spark, tmp_dir):
    rows = []
    for rid in range(3000):
        kinds = [("status", 200, None), ("line", None, token(f"a{rid}")), ("line", None, token("b")), ("close", None, None)]
        for seq, (kind, status, text) in enumerate(kinds[: 3 + rid % 2]):
            rows.append((rid, seq, T0 + dt.timedelta(seconds=seq + rid / 3001), kind, status, text))
    last = follow(spark, rows, tmp_dir, steps=2, events="events")
    assert events_of(SR.read_sink(spark, f"{tmp_dir}/events")) == events_of(R.relay_events(frame(spark, rows)))
    held = sum(s["numRowsTotal"] for s in last["stateOperators"])
    assert 0 < held <= BK.BUCKETS < 1500                                   # 1500 requests are open


class _State:
    """What a state function sees, between calls."""

    def __init__(self):
        self.value, self.due, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.due = None

    def setTimeoutTimestamp(self, due):  # noqa: N802
        self.due = due

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark


def test_a_bucket_ends_each_request_at_its_own_time():
    state = _State()
    at = lambda s: T0 + dt.timedelta(seconds=s)

    def rows(*found):
        return iter([pd.DataFrame(found, columns=["request_id", "seq", "ts", "kind", "status", "text", "delta"])])
    got = [*SR._relay((0,), rows((1, 0, at(0), "status", 200, None, None), (2, 0, at(30), "status", 200, None, None),
                                 (2, 1, at(31), "line", None, "", "x")), state)]
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert [r.kind for r in got[0].itertuples()] == ["token"] and state.due == base + 60_000
    state.hasTimedOut, state.watermark = True, base + 70_000
    ended = [*SR._relay((0,), iter(()), state)][0]
    assert ended[["request_id", "seq", "kind"]].values.tolist() == [[1, 1, "error"]] and state.due == base + 91_000
    state.hasTimedOut, state.watermark = False, base + 80_000              # what was seen already changes nothing
    assert not [*SR._relay((0,), rows((2, 1, at(31), "line", None, "", "x")), state)] and state.due == base + 91_000
    state.watermark = base + 95_000                                        # other requests' rows do not hold back its end
    both = pd.concat(SR._relay((0,), rows((3, 0, at(94), "status", 503, None, None)), state))
    assert sorted(both["request_id"]) == [2, 3] and not state.exists
    assert both["error"].tolist()[0] == R.TIMEOUT_MESSAGE
