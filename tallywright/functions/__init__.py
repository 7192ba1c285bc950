"""Scalar functions on columns: coercion, text and id normalisation, paging urls, diagnostics."""
