"""Operators on text for training data; optional, nothing else imports it."""
