"""Named queries that bind the operators to the test tables, each with its SQL where there is one."""

from sigloom.plans import augmentation, features, labels, metrics, normalizing, quality, reshaping, spectra, splitting, stores
from sigloom.plans.registry import ORACLES, QUERIES

__all__ = ["augmentation", "features", "labels", "metrics", "normalizing", "quality", "reshaping", "spectra", "splitting", "stores", "queries", "oracles"]


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
