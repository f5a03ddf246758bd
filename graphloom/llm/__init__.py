"""Operators for preparing large text and entity collections."""
