"""Decisions on proposals as a stream (an extension beyond the batch operators).

The state of a proposal is kept per key: a stream of decisions goes in, the state
after each accepted one or a conflict comes out, by the transitions of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.edit import TRANSITIONS

OUT = "proposal_id long, decision string, status string, conflict boolean"
MOVES = {(a, d): b for a, d, b in TRANSITIONS}


def _step(key: tuple, batches: Iterator, state: GroupState):
    import pandas as pd

    status = state.get[0] if state.exists else "pending"
    rows = []
    for pdf in batches:
        for decision in pdf.sort_values("seq")["decision"]:
            after = MOVES.get((status, decision))
            status = after or status
            rows.append((int(key[0]), decision, status, after is None))
    state.update((status,))
    yield pd.DataFrame(rows, columns=["proposal_id", "decision", "status", "conflict"])


def decide_stream(decisions: DataFrame) -> DataFrame:
    """decisions (streaming: proposal_id, seq, decision) with the status after each."""
    return decisions.groupBy("proposal_id").applyInPandasWithState(_step, OUT, "status string", "append", GroupStateTimeout.NoTimeout)
