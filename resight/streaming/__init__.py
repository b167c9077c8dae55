"""Continuous ingest of sightings."""
