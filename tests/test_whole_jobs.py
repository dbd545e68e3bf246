"""Jobs that leave no row of their input out, against plain versions on the given tables."""

import math
from collections import Counter, defaultdict

from panelkit import jobs
from panelkit.plans.series_jobs import returns

SF = "/root/testdata/sf0.01"


def test_entropy_counts_every_return(spark):
    rows = [(x.asset, x.r) for x in returns(spark, SF, "l_suppkey", "month").collect() if x.r is not None]
    lo, hi = min(r for _, r in rows), max(r for _, r in rows)
    bins = defaultdict(Counter)
    for asset, r in rows:
        bins[asset][max(0, min(19, math.floor((r - lo) / ((hi - lo) / 20))))] += 1
    found = {x.asset: x.entropy for x in jobs.QUERIES["a27_a28_entropy"](spark, SF).collect()}
    assert hi > 5 and set(found) == set(bins)
    for asset, c in bins.items():
        assert abs(found[asset] + sum(n / c.total() * math.log(n / c.total()) for n in c.values())) < 1e-6


def test_currency_keeps_rows_without_an_exact_result(spark):
    by_date = defaultdict(dict)
    for x in returns(spark, SF).collect():
        by_date[x.date][x.asset] = x.r
    expected = {(a, d): (1 + r, 1 + rs["N"]) for d, rs in by_date.items() if rs.get("N") is not None for a, r in rs.items() if a != "N"}
    found = {(x.asset, x.date): x for x in jobs.QUERIES["t10_t12_currency"](spark, SF).collect()}
    assert set(found) == set(expected)
    undefined = 0
    for key, (grown, fx) in expected.items():
        assert abs(found[key].additive - math.log(grown / fx)) < 1e-6
        exact = 1 + (grown - 1) / fx
        undefined += exact <= 0
        got = found[key].exact
        assert got is None if exact <= 0 else math.isclose(math.exp(got), exact, rel_tol=1e-6, abs_tol=1e-9), (key, got, exact)
    assert undefined
