"""Structured Streaming forms of chunked reading, running counts and epoch-wise file swapping."""

from .streams import *  # noqa: F403
