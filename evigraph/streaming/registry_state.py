"""The work registry as keyed state: one state machine an item, fed by a stream of actions.

An item's actions may come late, twice and out of order.  They wait in the item's state until the watermark has passed them, and are then
applied in order of their times, so that the log does not depend on how the stream was cut into batches.  An action older than the watermark is
late and dropped by Spark.  A timeout at the first waiting time wakes the item; nothing else reads its state.  States travel with the rows in Arrow
batches of many items (no call to the store for each), so that a batch costs what its rows and items cost.  The registry is never read
again as a whole: a batch touches the items it names.

Actions (``seq`` names one; the same seq twice is one action):

    add         an unknown item becomes pending; a known one stays as it is
    reset       pending from the start, whatever was known
    processing  done  failed  retry
                of a known item only; ``done`` keeps the old title if its own is empty, an error is cut at 500 characters,
                ``retry`` sets back to pending; of an unknown item nothing happens

An action without a time counts at ``seen`` (when its feed was read); without either it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Characters of an error that are kept.
MOST_ERROR = 500
#: The state of an item and the columns of the actions that wait, and the log.
STATE = "status string, title string, error string, added_at long, processed_at long, at array<long>, seq array<long>, action array<string>, titles array<string>, errors array<string>"
LOG = "seq long, action string, status string, title string, error string, added_us long, processed_us long"


class Item(NamedTuple):
    status: str
    title: str
    error: str
    added_at: int
    processed_at: int | None


class Action(NamedTuple):
    at: int
    seq: int
    action: str
    title: str
    error: str


def applied(item: Item | None, action: Action) -> Item | None:
    """The item after an action; the same object if nothing happens."""
    if action.action == "reset" or (action.action == "add" and item is None):
        return Item("pending", action.title, "", action.at, None)
    if item is None:
        return None
    if action.action == "processing":
        return item._replace(status="processing")
    if action.action == "done":
        return item._replace(status="done", title=action.title or item.title, error="", processed_at=action.at)
    if action.action == "failed":
        return item._replace(status="failed", error=action.error[:MOST_ERROR], processed_at=action.at)
    if action.action == "retry":
        return item._replace(status="pending", error="", processed_at=None)
    return item


def registry_step(names: list[str], key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One item: its new actions wait with those that are held; those that the watermark has passed are applied and logged.  Called for
    an item with new actions, and for one whose first waiting action the watermark has passed.  ``names`` are those of the log."""
    status, title, error, added, processed, *waiting = state.get if state.exists else (None, None, None, None, None, [], [], [], [], [])
    item = None if status is None else Item(status, title, error, added, processed)
    held = {a.seq: a for a in map(Action, *waiting)}
    for batch in rows:
        columns = (batch[c].tolist() for c in ("at_us", "seq", "action", "title", "error"))
        for at, seq, action, title, error in zip(*columns, strict=True):
            new = Action(at, seq, action, title or "", error or "")
            held[seq] = min(held.get(seq, new), new)
    passed = state.getCurrentWatermarkMs()
    out, later = [], []
    for action in sorted(held.values()):
        if action.at > passed * 1000:  # actions are kept in microseconds
            later.append(action)
            continue
        after = applied(item, action)
        if after is not item:
            item = after
            out.append((*key, action.seq, action.action, *item))
    if item is None and not later:
        state.remove()
    else:
        state.update((*(item or (None,) * 5), *([list(x) for x in zip(*later, strict=True)] or [[]] * 5)))
        if later:
            state.setTimeoutTimestamp(max(-(-later[0].at // 1000) - 1, passed, 1))  # it fires beyond, not at, this moment
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def registry_log(actions: DataFrame, keys: list[str], delay: str = "30 days") -> DataFrame:
    """(keys, seq, action, status, title, error, added_at, processed_at): a row for each action that had an effect, of a stream of actions
    (keys, seq, action, title, error, at, seen).  ``delay`` is how late an action may come.  Texts that no action uses are not kept."""
    at = F.coalesce(F.col("at"), F.col("seen"))
    dated = actions.withColumn("event_time", at).where(F.col("event_time").isNotNull()).withColumn("at_us", F.unix_micros("event_time"))
    title, error = F.when(F.col("action").isin("add", "reset", "done"), F.col("title")), F.when(F.col("action") == "failed", F.substring("error", 1, MOST_ERROR))
    slim = dated.withWatermark("event_time", delay).select(*keys, "seq", "action", title.alias("title"), error.alias("error"), "at_us", "event_time")
    kinds = ", ".join(f"`{k}` {actions.schema[k].dataType.simpleString()}" for k in keys)
    step = partial(registry_step, [*keys, *(field.split()[0] for field in LOG.split(", "))])
    log = slim.groupBy(*keys).applyInPandasWithState(lambda key, rows, state: step(key, rows, state), f"{kinds}, {LOG}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    times = [F.timestamp_micros(f"{c}_us").alias(f"{c}_at") for c in ("added", "processed")]
    return log.select(*keys, "seq", "action", "status", "title", "error", *times)
