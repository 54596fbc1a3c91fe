"""X1 reads a unit in one parse: the same nodes as the XPath it replaces."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codetrail.functions.call_nodes import call_nodes, nodes_of_call
from codetrail.functions.xml import ROOT, balanced, parsed, well_formed, wrapped
from codetrail.operators import facts as X

_CALL = f"/{ROOT}/call"
_LEAF = (f"{_CALL}/name/descendant-or-self::name[not(name)][not(following-sibling::name)]"
         "[not(ancestor::*[not(self::name)][ancestor::call])][not(ancestor::name[following-sibling::name][ancestor::call])]")
_PATH = f"{_LEAF}/text() | {_CALL}/argument_list/@*[name()='pos:start'] | {_CALL}/argument_list/argument"

ODD = [
    "", "plain", "<call/>", "<call><name>a</name></call>", "<call><name>cut", "<a></b>", "<a x='1' x='2'/>",
    "<call><name>a<!-- c -->b</name><argument_list pos:start='1:2'/></call>",
    "<call><name><![CDATA[a]]>b<?p q?>c</name><argument_list pos:start='1:2'/></call>",
    "<call><name>a<![CDATA[b]]>c<x/>d<![CDATA[e]]></name></call>", "<call><name><![CDATA[]]>x</name></call>",
    "<call><name>12:3</name><argument_list pos:start='4:5'>(<argument/>,<argument>x</argument>)</argument_list></call>",
    "<call><name>a</name><name>b<name>c</name><o>.</o><name>d</name>t</name>u<argument_list/></call>",
    "<call><name>b<name>c</name>t</name><x><name>q</name></x></call>", "<call><name><x><name>q</name></x>r</name></call>",
    "<call><name>a<x>b</x>c</name></call><call><name>&lt;&#65;&amp;</name></call>", "<call><name>&no;</name></call>",
    "<x><call><name>a</name></call></x>", "<s:call><name>a</name></s:call>", "<call><s:name>a</s:name><name s='/>'>b</name></call>",
    "<call><name>a]]>b</name></call>", "<?xml version='1.0'?><call><name>a</name></call>", "<?a b?><call><name>a</name></call>",
    "<!DOCTYPE a><call/>", "<call><name>a\r\nb &gt;/></name></call>", "<call><name>é\U0001f600</name></call>",
    "<call><argument_list pos:start='1:1' pos:end='2:2'><argument><argument/></argument></argument_list><argument/></call>",
    "<call><name>a</name><argument_list pos:start='1:1'/><name>z</name><argument_list pos:start='2:1'/></call>",
    "<call><name>a\x01</name></call>", "<call><name>a</name></call", "<call><name>a < b</name></call>", "<unit><call><name>n</name></call></unit>",
]


def _random_unit(r: random.Random, depth: int = 0) -> str:
    tag = r.choice(["call", "name", "name", "name", "argument_list", "argument", "x"] if depth else ["call", "call", "x"])
    attrs = r.choice(["", "", " pos:start='%d:%d'" % (r.randint(1, 9), r.randint(1, 9)), " a='/>'"])
    inner = "".join(r.choice(["t%d" % r.randint(0, 9), "&lt;", "<!-- <b> -->", "<![CDATA[<q]]>", "/>", "", "<br/>"])
                    if r.random() < .5 or depth > 4 else _random_unit(r, depth + 1) for _ in range(r.randint(0, 4)))
    return f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if r.random() < .997 else "")


@pytest.fixture(scope="module")
def units(spark):
    r = random.Random(5)
    texts = ODD + [_random_unit(r) for _ in range(3000)]
    return spark.createDataFrame(list(enumerate(texts)), "id INT, unit STRING").withColumn("doc", wrapped(F.col("unit")))


def test_call_nodes_are_those_of_the_xpath(units):
    old = F.when(parsed(F.col("doc"), "_none STRING").getField("_malformed").isNull(), F.xpath("doc", F.lit(_PATH))).otherwise(
        F.array().cast("array<string>"))
    rows = units.select("unit", F.transform(F.array("unit"), lambda u: u)[0].alias("u"), old.alias("old"),
                        call_nodes("doc").alias("new")).collect()
    assert [(x.unit, x.old) for x in rows] == [(x.unit, x.new) for x in rows]
    assert sum(len(x.new) > 1 for x in rows) > 50
    assert nodes_of_call(None) == []


def test_unbalanced_is_always_malformed(units):
    rows = units.select("unit", balanced(F.col("doc")).alias("balanced"), well_formed(F.col("doc")).alias("good"),
                        parsed(F.col("doc"), "_none STRING").getField("_malformed").isNull().alias("parses")).collect()
    assert [x.unit for x in rows if x.good != x.parses] == []
    assert Counter(x.balanced for x in rows)[False] > 3


def test_x1_parses_a_unit_once_without_xpath(spark):
    df = spark.createDataFrame([(1, 1, "p", '<unit>\n<unit item="1"><call><name>f</name><argument_list pos:start="3:1">(<argument>a'
                                 '</argument>)</argument_list></call></unit>\n</unit>')], "repo INT, idx INT, path STRING, calls_xml STRING")
    calls = X.calls_from_xml(df)
    assert [tuple(r) for r in calls.collect()] == [(1, 1, "p", 0, "f", 1, 3)]
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and "from_xml" not in plan and plan.count("call_nodes(") == 1
