"""Operators for preparing text and annotation data at corpus scale."""
