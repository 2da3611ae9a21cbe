"""Readers, request manifests and writers."""
