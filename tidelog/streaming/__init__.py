"""Streams over the log: change capture, replicas, state that expires."""
