"""Readers and writers of named inputs and outputs."""
