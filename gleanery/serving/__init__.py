"""Configuration and the read interface."""
