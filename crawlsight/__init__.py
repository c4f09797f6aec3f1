"""Crawl analytics as DataFrame -> DataFrame functions."""
