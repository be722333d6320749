"""Structured Streaming forms of batch operators (an extension, labelled as such)."""
