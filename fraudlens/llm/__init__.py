"""Operators that prepare large text corpora for model training.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames and returns DataFrames; the queries over the standard tables are in
``fraudlens.llm.queries``.
"""
