"""Statements: tokens, syntax tree, and the binder from the tree to DataFrames."""
