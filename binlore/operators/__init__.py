"""Relational, label, dataset and model operators."""
