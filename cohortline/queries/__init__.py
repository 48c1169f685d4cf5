"""Queries over the driver's tables, one or more for each operator, and SQL that gives the same rows."""

from . import artifacts, audits, boosting, challenges, checks, ensembles, evaluation, features, latent, learning, neighbours, noise, selection

_MODULES = (features, selection, audits, evaluation, challenges, artifacts, learning, boosting, neighbours, ensembles, noise, latent, checks)
QUERIES = {n: q for m in _MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in _MODULES for n, q in getattr(m, "ORACLES", {}).items()}
