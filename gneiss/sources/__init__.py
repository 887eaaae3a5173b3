"""Readers: raw block images, directory trees, and what can be decoded from them."""
