"""Streams: what a crawl appends, as tables kept up to date."""
