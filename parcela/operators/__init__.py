"""Part of parcela."""
