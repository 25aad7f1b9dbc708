"""Pages are made of rows that are dealt out already: no markup is shuffled."""

import os
import re

import pytest

from pricetrail.plans.markup import FRONT, _listing, pages_of
from pricetrail.plans.registry import Source

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_no_markup_is_shuffled(spark):
    source = Source(spark, FOLDER)
    for pages in (_listing(source), pages_of(source, FRONT, "orders", "o_orderkey")):
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        below = plan.split("Exchange")[1]
        assert "<div" in plan and "<div" not in re.sub(r"\s+", " ", below)
