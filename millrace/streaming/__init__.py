"""Structured Streaming versions of operators that take growing inputs."""
