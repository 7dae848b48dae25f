"""Loops over DataFrames, driven from the driver with lineage cut at intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from weftline.session import checkpoint

State = dict[str, DataFrame]


def loop(state: State, trips: int, body: Callable[[State, int], State], cut_every: int = 4) -> State:
    """``body`` for trips 0..trips-1; none if trips <= 0. Every ``cut_every`` trips what it changed is checkpointed."""
    for k in range(max(0, trips)):
        new = body(state, k)
        if (k + 1) % cut_every == 0 and k + 1 < trips:
            new = {n: checkpoint(df) if df is not state.get(n) else df for n, df in new.items()}
        state = new
    return state


def while_loop(state: State, test: Callable[[Row], bool], on: str, body: Callable[[State, int], State], most: int = 1000) -> tuple[State, int]:
    """``body`` while ``test`` of the one row of state[``on``] is true; returns the state and the trips.

    Each trip is checkpointed, as the test runs a job anyway. Raises after ``most`` trips.
    """
    for k in range(most + 1):
        rows = state[on].take(2)
        if len(rows) != 1:
            raise ValueError(f"{on} must have one row, the test is over a single partition")
        if not test(rows[0]):
            return state, k
        if k == most:
            break
        new = body(state, k)
        state = {n: checkpoint(df) if df is not state.get(n) else df for n, df in new.items()}
    raise RuntimeError(f"the loop didn't end in {most} trips")
