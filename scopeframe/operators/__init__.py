"""Operators over sources, scopes, symbols and references."""
