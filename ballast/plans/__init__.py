"""Registered queries: the operators over relations derived from the test tables."""
