"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``queries`` holds the thin
``opN_<name>`` queries; every other module holds one operator.
"""
