"""Landed items are rows before names are made of them; units that can't be well-formed aren't counted over in the plan."""

from __future__ import annotations

from codetrail.functions.call_nodes import nodes_of_call
from codetrail.operators import facts as X
from codetrail.sources.carriers import Landed


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_make_only_the_names_they_show(spark):
    L = Landed.get(spark, "/root/testdata/sf0.001")
    calls = _plan(L.call_facts)
    assert "transform(" not in calls and "replace(" not in calls
    decls = _plan(L.decl_facts)
    assert "transform(" not in decls and decls.count("replace(") == 1


def test_items_are_those_of_the_files(spark):
    L = Landed.get(spark, "/root/testdata/sf0.001")
    files = L.file_items.collect()

    def shown(i):
        return (i.l_partkey, i.p_name.replace(" ", "_"), i.p_size % 3, f"{i.p_type.lower()}_{i.p_size % 4}",
                f"org.lib.{i.p_type.lower()}.{i.p_brand.replace('#', '')}", i.q_name.replace(" ", "_"), i.q_size % 3)

    cols = ["l_partkey", "name", "n_args", "api", "cls", "old_name", "old_n_args"]
    want = {(v.repo, v.idx, v.fno, at, *shown(i)) for v in files for at, i in enumerate(v["_i"], 1)}
    assert len(want) > 1000 and sorted(map(tuple, L.items.select("repo", "idx", "fno", "r", *cols).collect())) == sorted(want)
    live = [(v, [i for i in v["_i"] if i.l_returnflag != "R"]) for v in files]
    want = {(v.repo, v.idx, v.fno, at, len(x), *shown(i)) for v, x in live for at, i in enumerate(x, 1)}
    assert sorted(map(tuple, L.live_items.select("repo", "idx", "fno", "rl", "k", *cols).collect())) == sorted(want)


def test_texts_make_only_the_names_they_show(spark):
    L = Landed.get(spark, "/root/testdata/sf0.001")
    for name in ("decls_xml", "calls_xml"):
        assert "q_name" not in _plan(L.listing(name)).split("Relation")[0]


def test_a_call_is_judged_where_it_is_parsed(spark):
    listing = spark.createDataFrame([(1, 1, "p", "x")], "repo long, idx long, path string, calls_xml string")
    assert "replace(" not in _plan(X.calls_from_xml(listing)).replace("regexp_replace(", "")
    good = '<unit><call><name>f</name><argument_list pos:start="3:1">(<argument>a</argument>)</argument_list></call></unit>'.replace("pos:start", "start")
    assert nodes_of_call(good) == ["f", None]
    assert nodes_of_call(good.replace("</name>", "")) == [] and nodes_of_call("<unit><call></unit>") == []
    assert nodes_of_call(good.replace("f</name>", "<!-- <b> -->f</name>")) == ["f", None]
