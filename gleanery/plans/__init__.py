"""Catalogue, probe texts and registered queries."""
