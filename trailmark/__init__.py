"""Crawler-traffic analytics and Markdown publishing as Spark jobs."""

from trailmark.config import Settings

__all__ = ["Settings"]
