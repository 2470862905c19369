"""Scans and sinks of images, feature tables and crawl lists."""
