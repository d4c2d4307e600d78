"""Acquisition analytics on Spark: crawl, attribution, identity, ingestion and content checks as DataFrame jobs."""
