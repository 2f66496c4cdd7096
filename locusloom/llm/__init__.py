"""Operators for preparing large training corpora; nothing outside imports this."""
