"""Lodestack: document-corpus analytics and retrieval on Spark DataFrames."""

from lodestack.io import Tables, load
from lodestack.session import get_session

__all__ = ["Tables", "get_session", "load"]
