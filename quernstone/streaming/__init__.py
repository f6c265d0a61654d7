"""Incremental processing: resumable batch labelling over a stream of files."""
