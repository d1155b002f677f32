"""Scanning source code and text at corpus scale with Spark."""
