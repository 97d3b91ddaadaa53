"""Structured Streaming jobs for logs, campaign progress, stacks and online tracking."""
