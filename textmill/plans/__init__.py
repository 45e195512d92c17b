"""Queries of the reference operators; importing the modules registers them."""
