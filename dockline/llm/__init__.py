"""Operators of a training-data pipeline over `documents` and `pages`.

Each module holds one operator with its own general interface; `queries.py`
derives the registered result columns from them.
"""
