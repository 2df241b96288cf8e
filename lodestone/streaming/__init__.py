"""The search log as a stream."""
