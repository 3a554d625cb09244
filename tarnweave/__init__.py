"""Stored-query matching, HTML extraction, URL algebra and crawl frontiers on Spark."""
