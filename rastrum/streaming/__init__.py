"""Structured Streaming forms of operators that need what came before."""
