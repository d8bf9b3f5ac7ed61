"""Operators for preparing training data.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin ``opN_<name>`` queries.
"""
