"""Readers and writers of the flat text formats."""

from .readers import *  # noqa: F403
from .writers import *  # noqa: F403
