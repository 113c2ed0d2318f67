"""Readers and writers of genetic file formats."""
