"""Operators for preparing training text: one module for each, all taking and returning DataFrames.

Nothing outside this folder imports it. Queries over whole tables are in :mod:`quarry.llm.queries`.
"""
