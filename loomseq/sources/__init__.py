"""Readers and writers: labelled CSV, dictionaries, configuration, metrics."""
