"""Imports every module of the package that registers queries."""

from __future__ import annotations

from textforge.llm import (  # noqa: F401
    bpe,
    decontaminate,
    divergence,
    jaccard,
    licenses,
    lm,
    pii,
    quality,
    sharding,
    suffix,
    toxicity,
    variants,
    warc,
)
from textforge.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
