"""Replies that arrive over time."""
