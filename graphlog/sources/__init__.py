"""Readers: logs, RDF text, document bundles, archives, directories, tables."""
