"""Readers of upstream payloads and the registry of named sources."""
