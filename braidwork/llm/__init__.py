"""Operators for preparing large training corpora. Nothing else in the package imports this subpackage."""
