"""Feedlake: a content-intelligence engine built from Spark DataFrame and Structured Streaming operators."""
