"""Text analysis and scalar functions."""
