"""End-to-end flows from a corpus to result tables."""
