"""Readers that turn stored documents into elements."""
