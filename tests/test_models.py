"""Model queries ask for whole fits."""
from __future__ import annotations

from augury.operators import models as M
from augury.plans import catalog, model_queries


def test_gate_rival_is_a_whole_fit(spark, monkeypatch):
    """The perceptron's rival has all rounds of the operator; one is run here."""
    rows = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 3), float(i % 2), float(i), i * 7 % 3 % 2) for i in range(120)], "lines double, quantity double, discount double, tax double, price double, home_win int")
    asked, fit = [], M.GBTClassifier

    def one_round(**kw):
        asked.append((kw["maxIter"], kw["stepSize"], kw["maxDepth"]))
        return fit(**kw | {"maxIter": 1})
    monkeypatch.setattr(M, "GBTClassifier", one_round)
    monkeypatch.setattr(model_queries, "split", lambda spark, d: (rows, rows))
    row = catalog.QUERIES["mlp_gated"](spark, "").first()
    assert asked == [(300, 0.05, 4)] and row["decision"] in ("kept", "dropped")
