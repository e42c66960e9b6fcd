"""Imports every module that registers queries."""

from sextant.plans import contract_queries, curation_queries, evaluation_queries, retrieval_queries, sequence_queries, text_queries  # noqa: F401
