"""DataFrame operators and the transforms that tasks name."""
