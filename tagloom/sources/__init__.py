"""Readers and writers for the files this work passes around."""
