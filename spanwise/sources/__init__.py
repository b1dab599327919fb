"""Readers and writers: typed extracts, code lists, snapshots and result files."""
