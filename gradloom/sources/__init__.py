"""Readers and writers for sample tables, archives, label files, weights and history."""
