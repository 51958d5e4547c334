"""The state of a relay by buckets of requests.

A state function called for every request in every micro-batch pays for a pandas
frame each time, many times what a dozen rows cost. Requests are dealt over
BUCKETS groups instead, and a bucket's state holds its open requests only: their
numbers, and when each is due. A call handles all rows of its bucket, and ends
all requests of the bucket that are due by the watermark; the bucket's own timer
is the earliest of its requests'. A bucket without open requests has no state.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Groups of requests; fixed once a stream has a checkpoint.
BUCKETS = 1024
STATE_DDL = "requests string"


def bucket(request: str = "request_id") -> Column:
    return F.pmod(F.xxhash64(F.col(request)), F.lit(BUCKETS)).cast("int")


def held_requests(state: GroupState) -> dict[int, list]:
    """What is held of every open request of a bucket; the last value is its due time in milliseconds."""
    return {rid: values for rid, *values in json.loads(state.get[0])} if state.exists else {}


def hold_requests(state: GroupState, held: dict[int, list], timers: bool = True) -> None:
    if held:
        state.update((json.dumps([[rid, *values] for rid, values in held.items()], ensure_ascii=False),))
        if timers:
            state.setTimeoutTimestamp(max(min(values[-1] for values in held.values()), 1))
    elif state.exists:
        state.remove()


def take_due(held: dict[int, list], watermark_ms: int, but: set[int] = frozenset()) -> dict[int, list]:
    """Remove and return the requests that are due, but for those with new rows."""
    due = {rid: values for rid, values in held.items() if values[-1] < watermark_ms and rid not in but}
    for rid in due:
        del held[rid]
    return due
