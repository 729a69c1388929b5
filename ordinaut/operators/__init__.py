"""Operators over sequences, tensors and maps."""
