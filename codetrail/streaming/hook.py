"""The per-commit extension hook.

The reference calls a user object once per commit, in history order, then
once at the end of each repository.  Here the commits are hash-partitioned by
repository and sorted by (repository, index) inside each partition; one
``mapInPandas`` pass then streams every partition through the callbacks in
Arrow batches, closing a repository when the next one starts.  A very large
repository is therefore streamed batch by batch, never materialised whole, and
there is one Python invocation per partition rather than one per repository.

A state that can be merged (``merge``) lifts the bound that a repository is one
task: stretches of a history are walked side by side, first to learn what state
each leaves, then, from the state that the stretches before it leave together,
to emit its rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.functions.lineage import materialize

#: Commits of a stretch.
STRETCH = 4096


def analyze_history(commits: DataFrame, on_commit: Callable[[Any, dict], tuple[Any, list[dict]]],
                    on_end: Callable[[Any, Any], list[dict]], schema: str, init: Callable[[], Any],
                    repo: str = "repo", order: str = "idx", merge: Callable[[Any, Any], Any] | None = None,
                    stretch: int = STRETCH) -> DataFrame:
    """Fold ``on_commit(state, row) -> (state, rows)`` over each repository's commits in
    ``order``; ``on_end((repo,), state) -> rows`` closes the repository.  Output rows follow ``schema``.

    Without ``merge`` the callback sees a repository's commits one after another, so a repository is one task: its memory is
    bounded by an Arrow batch and the callback's state, its time grows with the longest history.  With ``merge(before,
    after)``, which gives the state after two successive stretches from the states that each leaves by itself, a repository
    is as many tasks as it has stretches (of ``stretch`` successive integers of ``order``).  The rows are those of the
    plain walk; ``on_commit`` is called twice for each commit, and its state must pickle.
    """
    if merge is None:
        return _walked(commits, on_commit, on_end, schema, init, repo, order)
    part = commits.withColumn("_part", F.floor(F.col(order) / stretch).cast("long"))
    kind = dict(commits.dtypes)[repo]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fold(state, row):
            return on_commit(state, row)[0]
        for (name, number), state in _folded(batches, (repo, "_part"), fold, init):
            yield pd.DataFrame({"repo": [name], "part": [number], "state": [pickle.dumps(state)]})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, None, None
        for batch in batches:
            for name, number, own in zip(batch["repo"], batch["part"], batch["state"]):
                if held is not None:
                    yield pd.DataFrame([{**held, "last": name != current}])
                if held is None or name != current:
                    current, state = name, init()
                held = {"repo": name, "part": number, "state": pickle.dumps(state)}
                state = merge(state, pickle.loads(own))
        if held is not None:
            yield pd.DataFrame([{**held, "last": True}])

    spread = part.repartition(repo, "_part").sortWithinPartitions(repo, "_part", order)
    left = materialize(spread.mapInPandas(learn, f"repo {kind}, part long, state binary"))
    entered = materialize(left.repartition("repo").sortWithinPartitions("repo", "part")
                          .mapInPandas(enter, f"repo {kind}, part long, state binary, last boolean"))
    # the state goes in front of its stretch, once
    heads = entered.select(F.col("repo").alias(repo), F.col("part").alias("_part"), F.col("state").alias("_state"), F.col("last").alias("_last"))
    both = part.unionByName(heads, allowMissingColumns=True)
    columns = commits.columns

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _names(schema)
        state, last, key = None, False, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                if row["_state"] is not None:
                    if last:
                        out.extend(on_end((key,), state))
                    state, last, key = pickle.loads(row["_state"]), bool(row["_last"]), row[repo]
                    continue
                state, emitted = on_commit(state, {c: row[c] for c in columns})
                out.extend(emitted)
            if out:
                yield pd.DataFrame(out, columns=names)
        if last:
            tail = on_end((key,), state)
            if tail:
                yield pd.DataFrame(tail, columns=names)

    ready = both.repartition(repo, "_part").sortWithinPartitions(repo, "_part", F.col("_state").isNull(), order)
    return ready.mapInPandas(emit, schema=schema)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def _folded(batches: Iterator[pd.DataFrame], keys: tuple[str, ...], step: Callable[[Any, dict], Any],
            init: Callable[[], Any]) -> Iterator[tuple[tuple, Any]]:
    """The state of each run of rows with equal keys."""
    current, state = None, None
    for batch in batches:
        for row in batch.to_dict("records"):
            key = tuple(row[k] for k in keys)
            if key != current:
                if current is not None:
                    yield current, state
                current, state = key, init()
            state = step(state, {c: v for c, v in row.items() if c != "_part"})
    if current is not None:
        yield current, state


def _walked(commits: DataFrame, on_commit: Callable[[Any, dict], tuple[Any, list[dict]]],
            on_end: Callable[[Any, Any], list[dict]], schema: str, init: Callable[[], Any], repo: str, order: str) -> DataFrame:
    """Each repository in one task."""
    cols = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                key = row[repo]
                if key != current:
                    if current is not None:
                        out.extend(on_end((current,), state))
                    current, state = key, init()
                state, emitted = on_commit(state, row)
                out.extend(emitted)
            if out:
                yield pd.DataFrame(out, columns=cols)
        if current is not None:
            tail = on_end((current,), state)
            if tail:
                yield pd.DataFrame(tail, columns=cols)

    ordered = commits.repartition(repo).sortWithinPartitions(repo, order)
    return ordered.mapInPandas(run, schema=schema)
