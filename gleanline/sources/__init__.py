"""Readers of texts that other tools write, and sinks for what they read."""
