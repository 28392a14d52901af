"""Imports every catalog module so that the registry is complete."""

from . import q_ask, q_build, q_corpus, q_relational, q_scalars, q_shards, q_stream, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
