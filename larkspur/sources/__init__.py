"""Readers of files, captured pages and directories."""
