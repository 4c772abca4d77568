"""Operators for preparing language-model training data. Nothing else in cytolake imports this package."""
