"""The registered queries train to the library's own limit."""

import pytest

from propval.functions import rules as R
from propval.operators import model as M
from propval.plans import catalog


def test_the_queries_train_all_rounds(spark, monkeypatch):
    """Before: 400 rounds at most, of the original's 3000."""
    asked = []
    table = spark.createDataFrame([(False, 0, "Villa", 1.0, 2.0)], "is_test boolean, fold int, type_clean string, a double, log_price double")

    def boost(train, held_out, max_rounds, *args, **kw):
        asked.append(max_rounds)
        raise StopIteration

    monkeypatch.setattr(M, "boost", boost)
    monkeypatch.setattr(catalog, "_CACHE", {})
    monkeypatch.setattr(catalog, "_model_table", lambda spark, sf: (table, ["a"]))
    monkeypatch.setattr(catalog, "_chosen", lambda spark, sf: ["a"])
    for train in (catalog._ensemble, catalog._both_models):
        with pytest.raises((StopIteration, RuntimeError)):
            train(spark, "unused")
    assert asked and set(asked) == {R.ENSEMBLE_ROUNDS}
