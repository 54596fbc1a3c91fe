"""Listings are made where they are read; line items travel without columns that order nothing."""

from __future__ import annotations

import pytest

from codetrail.functions.lineage import materialize
from codetrail.sources.carriers import LISTINGS, Landed


@pytest.fixture(scope="module")
def landed(spark):
    return Landed.get(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", LISTINGS)
def test_a_listing_is_a_column_of_the_landed_listings(landed, name):
    got, want = landed.listing(name), landed.parsed_xml.select("repo", "idx", "path", name)
    assert want.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_filter_on_a_listing_does_not_make_it_again(landed):
    x = landed.listing("calls_xml")
    plan = x.filter(x.calls_xml.contains("a") & x.calls_xml.contains("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translator error") == 1 and "decl_u" not in plan


def test_line_items_travel_without_what_orders_nothing(landed):
    assert set(landed.touched.schema["lines"].dataType.elementType.names) == {"l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"}
    from codetrail.sources import carriers
    assert not set(carriers.LINE_ORDER) & {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"}


def test_landed_tables_are_written_with_zstd(spark):
    import glob

    import pyarrow.parquet as pq
    path = materialize(spark.range(10)).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    part = glob.glob(f"{path}/part-*")[0]
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
