"""Importing this module registers every query."""

from checks import search  # noqa: F401
from checks import pages, texts  # noqa: F401
from checks import lists  # noqa: F401
from checks import plans  # noqa: F401
