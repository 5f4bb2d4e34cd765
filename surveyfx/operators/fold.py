"""A hook for user functions on groups of any size.

`fit_by` hands a whole group to one call, which needs reduced input. Here the user gives three functions instead: a
state for a piece of a group, the merge of two states, and the rows that a final state stands for. Every task folds its
own rows, states are merged in a tree, and no call ever sees more than a batch of rows or a bounded number of states, so
a question that holds a third of all rows is spread over the cluster like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from surveyfx.operators.fit import result_frame

#: Groups whose states a task holds before it passes them on, and tasks whose states meet in one merge.
GROUPS_HELD, FAN = 1000, 256


def fold_by(
    rows: DataFrame, by: Sequence[str], partial: Callable[[pd.DataFrame], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], list[dict]], fields: str
) -> DataFrame:
    """Columns: `by`, then `fields`, which should hold `converged` and `error`.

    `partial` sees some rows of one group without their order, and `merge` must not care how rows were dealt out. An
    exception in any of the three becomes a row of its group with `converged` false and the message.
    """
    keys = list(by)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    names = [f.split()[0] for f in fields.split(", ")]

    def guarded(fn: Callable, *args: Any) -> tuple[bool, Any]:
        """(worked, result or message)"""
        try:
            return True, fn(*args)
        except Exception as e:  # noqa: BLE001 - a group that cannot be folded must not stop the others
            return False, f"{type(e).__name__}: {e}"

    def joined(a: tuple[bool, Any], b: tuple[bool, Any]) -> tuple[bool, Any]:
        return guarded(merge, a[1], b[1]) if a[0] and b[0] else a if not a[0] else b

    def packed(part: int, states: dict[tuple, tuple[bool, Any]]) -> pd.DataFrame:
        return result_frame([dict(zip(keys, key)) | {"part": part, "state": pickle.dumps(s)} for key, s in states.items()], [*keys, "part", "state"])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, states = TaskContext.get().partitionId() // FAN, {}
        for batch in batches:
            for key, frame in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                s = guarded(partial, frame)
                states[key] = joined(states[key], s) if key in states else s
            if len(states) > GROUPS_HELD:
                yield packed(part, states)
                states = {}
        if states:
            yield packed(part, states)

    def merged(frame: pd.DataFrame) -> tuple[bool, Any]:
        states = [pickle.loads(s) for s in frame["state"]]
        out = states[0]
        for s in states[1:]:
            out = joined(out, s)
        return out

    def up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return packed(key[-1], {key[:-1]: merged(frame)})

    def end(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        worked, state = merged(frame)
        worked, found = guarded(finish, state) if worked else (False, state)
        out = found if worked else [{"converged": False, "error": found}]
        return result_frame([dict(zip(keys, key)) | r for r in out], [*keys, *names])

    states = f"{head}, part int, state binary"
    partials = rows.mapInPandas(start, states)
    return partials.groupBy(*keys, "part").applyInPandas(up, states).groupBy(*keys).applyInPandas(end, f"{head}, {fields}")
