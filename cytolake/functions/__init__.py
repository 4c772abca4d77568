"""Part of cytolake."""
