"""The sampling loop: burn-in, thinning, buffered writes, diagnostics, saved state."""

from __future__ import annotations

import time

from kinfold.sources import tables

from .state import save_state
from .transition import SAMPLERS, ChainState, aggregate_distortions, isolated, linkage, log_likelihood, record_distortions, step


def diagnostics_header(state: ChainState) -> list[str]:
    names = [a.name for a in state.index.attributes]
    return ["iteration", "systemTime-ms", "numObservedEntities", "logLikelihood", "popSize", *[f"aggDist-{n}" for n in names], *[f"recDistortion-{k}" for k in range(len(names) + 1)]]


def diagnostics_row(state: ChainState) -> tuple:
    """One saved sample's numbers, in the header's order."""
    size = state.parts.count()
    by_attr: dict[int, int] = {}
    for r in aggregate_distortions(state).collect():
        by_attr[r["attr_id"]] = by_attr.get(r["attr_id"], 0) + r["n"]
    by_record = {r["n_distorted"]: r["n"] for r in record_distortions(state).collect()}
    n = len(state.index.attributes)
    return (
        state.iteration, int(time.time() * 1000), size - isolated(state).first()[0], f"{log_likelihood(state).first()[0]:.9e}", size,
        *[by_attr.get(k, 0) for k in range(n)], *[by_record.get(k, 0) for k in range(n + 1)],
    )


def sample(state: ChainState, size: int, output: str, burnin: int = 0, thinning: int = 1, sampler: str = "PCG-I", buffer: int = 10, scratch: tables.Scratch | None = None) -> ChainState:
    """Draws `size` samples of the linkage and appends them to output/linkage-chain.parquet.

    A new chain without burn-in also writes its initial state. With burn-in b the samples are at b,
    b + thinning, …; a state of a later iteration goes on with the chain there is. Each step's tables are
    written to the scratch folder, so plans stay short and a lost executor costs no more than a stage; tables
    of steps long past go. Returns the state as it is saved in output/state. scratch: the one that holds the
    tables of the state, if any; whoever made it closes it.
    """
    if size <= 0 or burnin < 0 or thinning <= 0 or buffer <= 0:
        raise ValueError("size, thinning and buffer must be positive, burnin not negative")
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler}")
    spark, fresh = state.cells.sparkSession, state.iteration == 0
    chain, numbers = f"{output}/linkage-chain.parquet", f"{output}/diagnostics.csv"
    own = scratch or tables.Scratch(spark)
    drafts: tables.Scratch | None = None
    waiting: list = []
    rows: list[tuple] = []
    append = not fresh
    if fresh and tables.exists(spark, numbers):
        tables.remove(spark, numbers)

    def flush() -> None:
        nonlocal append, drafts
        if waiting:
            union = waiting[0]
            for w in waiting[1:]:
                union = union.unionByName(w)
            tables.write_chain(union, chain, append)
            tables.append_csv(spark, rows, diagnostics_header(state), numbers)
            append = True
            waiting.clear()
            rows.clear()
            drafts.close()
            drafts = None

    def emit(s: ChainState) -> None:
        nonlocal drafts
        drafts = drafts or tables.Scratch(spark, own.root)
        waiting.append(drafts(linkage(s), "linkage"))
        rows.append(diagnostics_row(s))
        if len(waiting) >= buffer:
            flush()

    if fresh and burnin == 0:
        emit(state)
    drawn = 0
    while drawn < size:
        own.step()
        state = step(state, sampler, own)
        at = state.iteration
        if burnin and fresh:
            due = at >= burnin and (at - burnin) % thinning == 0
        else:
            due = at % thinning == 0
        if due:
            emit(state)
            drawn += 1
    flush()
    state = save_state(state, f"{output}/state")
    if scratch is None:
        own.close()
    return state
