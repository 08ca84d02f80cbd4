"""Operators for preparing text corpora for training.

Nothing outside this subpackage imports it; ``queries`` lists its registered
queries and ``oracle`` their SQL.
"""
