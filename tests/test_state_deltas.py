"""Delta form of project states (H6, H7): expanded rows are the plain ones, and the size is that of the changes."""

import random

import pytest
from pyspark.sql import functions as F

from codetrail.operators import history as H

EVENTS = "repo string, idx int, path string, event string"


def _history(rng, repo, n, files):
    """Random adds, edits and deletions; returns the events and, for each commit, path -> version."""
    alive, events, states = {}, [], []
    for idx in range(1, n + 1):
        for path in rng.sample(files, rng.randint(0, 3)):
            if path in alive:
                events.append((repo, idx, path, "delete"))
                del alive[path]
                if rng.random() < 0.5:
                    continue
            events.append((repo, idx, path, "add"))
            alive[path] = idx
        states.append(dict(alive))
    return events, states


@pytest.mark.parametrize("every", [1, 4, 7, 4096])
def test_expanded_deltas_are_the_states(spark, every):
    rng = random.Random(every)
    files = [f"src/F{i}.java" for i in range(8)] + ["README"]
    events, want = [], {}
    for repo, n in (("a", 29), ("b", 4), ("c", 1)):
        own, states = _history(rng, repo, n, files)
        events += own
        want.update({(repo, i + 1): s for i, s in enumerate(states)})
    intervals = H.file_intervals(spark.createDataFrame(events, EVENTS))
    commits = spark.createDataFrame(list(want), "repo string, idx int")
    deltas = H.state_deltas(intervals, commits, every=every)
    got = H.expand_deltas(deltas, commits.unionByName(commits), every=every).collect()
    assert sorted((r.repo, r.idx, r.path, r.version) for r in got) == sorted(
        (repo, idx, path, v) for (repo, idx), s in want.items() for path, v in s.items())
    java = H.expand_deltas(H.state_deltas(intervals, commits, every=every, suffix=".java"), commits, every=every)
    plain = H.files_at_commit(intervals, commits, suffix=".java")
    assert sorted(map(tuple, java.select("repo", "idx", "path").collect())) == sorted(map(tuple, plain.collect()))


def test_deltas_are_no_longer_than_the_changes(spark):
    n, every = 600, 256
    events = spark.range(1, n + 1).select(F.lit("r").alias("repo"), F.col("id").cast("int").alias("idx"),
                                          F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("add").alias("event"))
    commits = events.select("repo", "idx")
    kinds = {r["change"]: r["count"] for r in
             H.state_deltas(H.file_intervals(events), commits, every=every).groupBy("change").count().collect()}
    assert kinds == {"add": n, "full": 256 + 512}


def test_texts_of_versions_and_empty_tables(spark):
    events = spark.createDataFrame([("r", 1, "a", "add"), ("r", 2, "b", "add"), ("r", 3, "a", "delete"), ("r", 3, "a", "add"),
                                    ("r", 4, "b", "delete")], EVENTS)
    commits = spark.createDataFrame([("r", i) for i in range(1, 5)], "repo string, idx int")
    texts = spark.createDataFrame([("r", "a", 1, "one"), ("r", "a", 3, "three")], "repo string, path string, idx int, content string")
    deltas = H.state_deltas(H.file_intervals(events), commits, every=2)
    assert [r.idx for r in deltas.filter("change = 'gone'").collect()] == [4]
    files = H.expand_deltas(deltas, commits, every=2)
    assert sorted((r.idx, r.path, r.content or "") for r in H.content_of_versions(files, texts).collect()) == [
        (1, "a", "one"), (2, "a", "one"), (2, "b", ""), (3, "a", "three"), (3, "b", ""), (4, "a", "three")]
    none = H.state_deltas(H.file_intervals(events.limit(0)), commits.limit(0))
    assert none.collect() == [] and H.expand_deltas(none, commits).collect() == []
