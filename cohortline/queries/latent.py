"""Queries of learned vectors: field-aware factors against plain ones on the same fields, and a perceptron over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import auc, logloss
from ..operators import folds as L
from ..operators import latent as N
from ..sources.accounts import accounts

_FIELDS, _NUMERIC = ("PaymentMethod", "Contract", "InternetService", "PaperlessBilling", "TechSupport"), ("tenure", "MonthlyCharges")
_BITS = 8


def _report(s: SparkSession, d: str, model: N.FieldAware | N.EmbeddingPerceptron, rate: float) -> DataFrame:
    dealt = L.stratified_folds(accounts(s, d), 2, 7)
    rows = N.hashed_rows(dealt, _FIELDS, _NUMERIC, bits=_BITS, batches=4)
    got = N.fit(rows, model, models=2, epochs=3, batches=4, rate=rate).predict(rows, "p")
    losses = got.groupBy("fold").agg(F.round(F.avg(logloss("y", "p")), 4).alias("logloss"))
    return auc(got, ["fold"], "y", "p").withColumn("auc", F.round("auc", 4)).join(losses, "fold")


QUERIES = {
    "learner_field_aware": lambda s, d: _report(s, d, N.FieldAware(len(_FIELDS), 1 << _BITS, 4, len(_NUMERIC)), 0.2),
    "learner_embedded": lambda s, d: _report(s, d, N.EmbeddingPerceptron(len(_FIELDS), 1 << _BITS, 4, 16, len(_NUMERIC)), 0.1),
}
