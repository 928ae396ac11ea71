"""Readers of raw logs and the formats that turn lines into events."""
