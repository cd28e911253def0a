"""Operators for preparing large text corpora for training.

Every operator takes and returns DataFrames.  Nothing else in the library imports this subpackage.
"""
