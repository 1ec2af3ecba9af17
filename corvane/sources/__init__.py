"""Readers that give documents (source, text, ...) from files of several kinds."""
