"""Operators for training-data pipelines over document corpora.

One module per operator, each with a general interface over a DataFrame and its column names;
``queries`` binds them to the given tables. Nothing else in the library imports this package.
"""
