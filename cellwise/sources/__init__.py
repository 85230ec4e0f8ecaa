"""Ensembles, inventories and results as tables."""
