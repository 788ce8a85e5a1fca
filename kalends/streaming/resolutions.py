"""Decisions on duplicate groups as they come, with undo and reset."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED, STACK = "group long, type string, seq long", "types array<string>, seqs array<long>"


def step(types: list[str], seqs: list[int], kind: str, seq: int) -> None:
    """A decision goes on its group's stack, an undo takes the last one off, a reset all."""
    if kind == "reset":
        types.clear()
        seqs.clear()
    elif kind != "undo":
        types.append(kind)
        seqs.append(seq)
    elif types:
        types.pop()
        seqs.pop()


def latest_decisions(resolutions: DataFrame) -> DataFrame:
    """The decision that counts for each group of a stream of (seq, group, type), a row whenever it may have changed.

    The same as `contact_merge.latest` of all rows so far; type and seq are null
    for a group whose decisions were all taken back. A group's rows come in the
    order of seq from batch to batch; within one they are sorted. A group's state
    is its stack, so it grows with the decisions that aren't taken back.
    """

    def take(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        types, seqs = map(list, state.get) if state.exists else ([], [])
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for kind, seq in zip(every["type"], every["seq"], strict=True):
            step(types, seqs, kind, int(seq))
        state.update((types, seqs))
        yield pd.DataFrame({"group": [key[0]], "type": types[-1:] or [None], "seq": pd.array(seqs[-1:] or [None], "Int64")})

    rows = resolutions.select("group", "type", "seq")
    return rows.groupBy("group").applyInPandasWithState(take, DECIDED, STACK, "update", GroupStateTimeout.NoTimeout)
