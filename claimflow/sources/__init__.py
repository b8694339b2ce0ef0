"""Readers, writers and seed-driven row generators."""
