"""Readers and writers, and the readings derived from the event table."""
