"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin ``op*`` queries are in
``tideline.llm.queries``.
"""
