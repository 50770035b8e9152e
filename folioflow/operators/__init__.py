"""Operators from frames to a frame."""
