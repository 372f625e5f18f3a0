"""Readers, writers and request builders."""
