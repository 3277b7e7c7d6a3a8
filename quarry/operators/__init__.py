"""Search operators over an index frame."""
