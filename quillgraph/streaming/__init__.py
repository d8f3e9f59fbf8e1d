"""Structured Streaming: what a batch operator computes, kept up to date."""
