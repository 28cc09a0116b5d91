"""Readers, writers and column resolution for ticket tables and results."""
