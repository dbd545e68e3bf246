"""Names that are equal by their letters; the scenario chain against numpy, and the rules that it counts."""

import numpy as np
import pytest

from panelkit.operators import joins as J
from panelkit.operators import scenario_chain as K


def test_names_by_letters(spark):
    same = {"Fiji": ["FIJI", "ﬁji", "ﬀ"[:0] + "Ｆｉｊｉ", "fïji", "fïji"], "Côte d'Ivoire": ["COTE D IVOIRE", "Côte—d'Ivoire", "cote  d’ivoire"], "Trinidad & Tobago": ["trinidad and tobago", "Trinidad ＆ Tobago"], "Vest": ["veﬆ"]}
    left = spark.createDataFrame([(k,) for k in same] + [("Nowhere",), (None,), ("US",)], "name string")
    for n, spelled in enumerate(zip(*(v + [v[-1]] * (5 - len(v)) for v in same.values()))):
        right = spark.createDataFrame([(s, k) for k, s in zip(same, spelled)] + [("Elsewhere", "x"), (None, "null"), ("U.S.A", "states")], "spelled string, found string")
        out = {r.name: r.found for r in J.on_name(left, right, "name", "spelled", {"us": "united states", "u s a": "United  States"}).collect()}
        assert out == {k: k for k in same} | {"Nowhere": None, None: None, "US": "states"}, n


def chain(spark, rows, chances, horizons=(2, 3)):
    return K.terminal_returns(spark.createDataFrame(rows, "scen_id int, asset string, month int, log_ret double"), spark.createDataFrame(chances, "scen_id int, p double"), "fx", {"usd"}, horizons)


def test_chain_and_its_rules(spark):
    rng = np.random.default_rng(4)
    rows = [(s, a, m, float(rng.normal(0, 0.1))) for s in range(3) for a in ("fx", "usd", "eur") for m in (1, 2, 3)]
    chances = [(0, 0.2), (1, 0.3), (2, 0.5)]
    found, counts = chain(spark, rows, chances)
    assert not any(counts.values()) and K.require(counts) is None
    x = {(s, a, m): v for s, a, m, v in rows}
    out = {(r.scen_id, r.asset): r for r in found.collect()}
    assert set(out) == {(s, a) for s in range(3) for a in ("usd", "eur")}
    for (s, a), r in out.items():
        path = [x[s, a, m] - (x[s, "fx", m] if a == "usd" else 0) for m in (1, 2, 3)]
        two, three = np.expm1(sum(path[:2])), np.expm1(sum(path))
        assert np.allclose([r.ret_2, r.ret_3, r.yearly_2, r.yearly_3, r.p], [two, three, (1 + two) ** 6 - 1, (1 + three) ** 4 - 1, dict(chances)[s]])
    bad = [r for r in rows if r[:3] != (0, "fx", 2)] + [(1, "eur", 9, 0.1), (2, "usd", 1, float("nan"))]
    _, counts = chain(spark, bad, [(0, -0.2), (1, 0.3)])
    assert counts == {"not_finite": 1, "months_outside": 1, "without_rate": 3, "broken_paths": 2, "without_p": 2, "p_not_finite": 0, "negative_p": 1, "sum_not_one": 1}
    with pytest.raises(ValueError, match="without_rate"):
        K.require(counts)


def test_months_of_long_paths_are_told_apart(spark):
    whole = [(0, a, m, 0.01) for a in ("fx", "usd") for m in range(1, 131)]
    assert not any(chain(spark, whole, [(0, 1.0)], (12, 130))[1].values())
    twice = [(*r[:2], 3 if r[1:3] == ("usd", 130) else r[2], 0.01) for r in whole]  # 130 rows, but one month twice
    assert chain(spark, twice, [(0, 1.0)], (12, 130))[1]["broken_paths"] == 1
