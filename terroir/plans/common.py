"""Shared derived inputs for the query plans."""

from __future__ import annotations

from ..operators import transform as X
from ..sources import proxies as P


def samples_split(spark, sf):
    """``samples`` with the exact stratified ``split`` column (train/val/test)."""
    return X.stratified_split(P.samples(spark, sf), "crop", "sample_id")
