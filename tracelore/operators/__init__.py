"""Relational operators over traces, episodes, features and predictions."""
