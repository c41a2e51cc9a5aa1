"""Listing over streams of new documents."""
