"""Readers and writers: raw logs, codecs, exports, profiles and metrics."""
