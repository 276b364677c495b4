"""Readers, sinks and scratch tables."""
