"""Retrieval and ranking analytics over document, graph and usage tables, on Spark."""

from wayfind.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
