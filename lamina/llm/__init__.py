"""Operators for building training corpora out of a table of documents.

One module per operator; ``queries`` registers the contract queries over the
driver's tables.  Nothing outside this subpackage imports it.
"""
