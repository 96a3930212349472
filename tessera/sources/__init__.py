"""Readers and sinks: line-numbered JSONL, chunked JSON, folders, series, pages, split outputs, captions, collections."""
