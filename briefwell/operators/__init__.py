"""DataFrame operators of the brief: each takes frames and returns a frame."""
