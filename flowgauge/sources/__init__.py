"""Readers, writers and the fixed vocabulary of flow exports."""
