"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames,
selects the columns it needs by name (extra columns are ignored, whatever they are
called) and returns a DataFrame.
"""
