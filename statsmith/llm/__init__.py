"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its id and text columns, reads only those columns
(extra columns, whatever their names, never clash) and returns rows keyed by
the id.
"""
