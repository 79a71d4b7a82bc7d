"""Readers and writers of photos, annotations and checkpoints."""
