"""Streams of changed files and of events."""
