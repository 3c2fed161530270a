"""Whole tools: each composes sources and operators into one digest, and the query registry."""
