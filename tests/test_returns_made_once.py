"""A return that several datasets are taken from is made once."""

import pytest

from taxloom.operators import period
from taxloom.plans import queries


@pytest.mark.parametrize("name", ["filing_note", "workpapers"])
def test_a_return_is_made_once(spark, sf, monkeypatch, name):
    made, whole = [], period.period_return
    monkeypatch.setattr(period, "period_return", lambda *a: made.append(whole(*a)) or made[-1])
    queries.QUERIES[name](spark, sf)
    assert len(made) == 1
