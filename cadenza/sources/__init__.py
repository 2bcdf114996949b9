"""Readers and writers of audio containers."""
