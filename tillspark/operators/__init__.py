"""Catalog, order, payment, stock, cart and validation operators."""
