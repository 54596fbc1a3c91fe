"""Groups times APIs: the rows are dealt over tasks, and what only counts them makes none."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from codetrail.operators import replace as G

N_APIS, N_GROUPS = 300, 200


@pytest.fixture(scope="module")
def tables(spark):
    """One call that nearly all groups ask for, with one package set; another group without an API, and one without a package."""
    apis = [(i, f"org.lib.c{i % 3}.C{i % 7}", "get", 0, True) for i in range(N_APIS)]
    apis += [(9000, "org.lib.c1.X", "get", 0, False), (9001, "org.lib.c1.X", "get", 1, True)]
    groups = [("r", i, "o", 0, "get", 0, 1, (["org.lib.c1."],)) for i in range(N_GROUPS)]
    groups += [("r", 900, "o", 0, "zz", 0, 1, (["org.lib.c1."],)), ("r", 901, "o", 0, "get", 0, 1, ([],)), (None, 902, "o", 0, "get", 1, 1, (["c1"],))]
    return (spark.createDataFrame(groups, "repo string, idx int, old_name string, old_n_args int, new_name string, new_n_args int, gid int, "
                                          "rep struct<packages:array<string>>"),
            spark.createDataFrame(apis, "id int, class string, name string, n_args int, is_public boolean"))


WANT = sorted([(i, a) for i in range(N_GROUPS) for a in range(1, N_APIS, 3)] + [(902, 9001)])


def test_the_rows_of_a_popular_call_are_dealt_over_tasks(tables):
    found = G.candidate_apis(*tables, rows_at_once=500).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.idx, r.api_id) for r in found) == WANT
    tasks = Counter(r.task for r in found)
    assert len(tasks) > 4 and max(tasks.values()) < len(found) / 2


@pytest.mark.parametrize("rows_at_once", [1, 1 << 20])
def test_any_cut_gives_the_same_rows(tables, rows_at_once):
    assert sorted((r.idx, r.api_id) for r in G.candidate_apis(*tables, rows_at_once=rows_at_once).collect()) == WANT


def test_lists_hold_the_rows_and_are_counted(tables):
    groups, catalog = tables
    lists = G.candidate_apis(groups, catalog, lists=True)
    assert sorted((r.idx, a) for r in lists.collect() for a in r.api_ids) == WANT
    assert lists.count() < len(WANT) / 10
    counts = G.with_candidate_count(groups, lists).collect()
    rows = G.with_candidate_count(groups, G.candidate_apis(groups, catalog)).collect()
    assert sorted(map(str, counts)) == sorted(map(str, rows)) and {r.idx: r.n_candidates for r in counts}[900] == 0


def test_a_run_writes_no_candidate_rows(spark, monkeypatch):
    """The result tables that only count candidates don't make a row of each."""
    from codetrail.plans import mining
    from codetrail.sources.carriers import Landed
    L = Landed.get(spark, "/root/testdata/sf0.001")
    members, groups = L.members, L.mined_groups
    written = []
    monkeypatch.setattr(mining, "materialize", lambda df: written.append(df.columns) or df)
    mined = mining.results(groups, members, L.mining)
    assert not [c for c in written if "api_id" in c]
    counted = {r.id: r.nCandidateAPIs for r in mined.replacements.collect()}
    assert Counter(r.replacement_id for r in mined.candidates.collect()) == Counter({i: n for i, n in counted.items() if n})
