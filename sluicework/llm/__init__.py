"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries``
holds the thin ``opN_<name>`` queries that apply the operators to whole tables.
"""
