"""Registered queries over the test tables and SQL that says the same."""

from faultsift.catalog import (  # noqa: F401
    features,
    graphs,
    history,
    interactions,
    localization,
    models,
    ranking,
    sampling,
    storage,
    tables,
    texts,
    vectors,
)
from faultsift.catalog.registry import ORACLES, QUERIES  # noqa: F401
