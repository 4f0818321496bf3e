"""Spark jobs for knowledge corpora: structuring, checking, translating, searching and measuring text."""
