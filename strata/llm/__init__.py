"""Operators for large-scale text-corpus preparation.  Nothing else in ``strata`` imports this subpackage."""
