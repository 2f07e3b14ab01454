"""DataFrame operators between a source and a sink, and over the run tables."""
