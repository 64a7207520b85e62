"""Spark jobs for profile scoring, visit counting, payload gates, routing and sitemaps."""
