"""Operators for preparing language-model training data at cluster scale.

Nothing else in the library imports this subpackage.
"""
