"""Schemas, readers, sinks and the merge of many binaries."""
