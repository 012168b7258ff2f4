"""Relational operators over packets and detection results."""
