"""Readers and writers: captures, articles, memory files, sheets, sitemaps, histories."""
