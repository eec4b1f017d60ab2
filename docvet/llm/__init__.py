"""Operators for building language-model training data.

Nothing outside this folder imports it; ``queries`` registers one ``opN_`` query per operator.
"""
