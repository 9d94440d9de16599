"""Operators over transaction histories."""
