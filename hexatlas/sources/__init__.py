"""Readers, writers and dataset registries."""
