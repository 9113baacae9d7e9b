"""Rules over column and file names."""

from __future__ import annotations

import re

# The tokens that mark an identifier column, between separators.
ID_TOKEN = re.compile(r"(?:^|[_-])(id|uuid|index|key)(?:$|[_-])")


def names_an_identifier(name: str) -> bool:
    return ID_TOKEN.search(name.lower()) is not None


def extension_of(name: str) -> str:
    """Lower-case suffix with its dot, or an empty text."""
    head, dot, tail = name.rpartition(".")
    return dot + tail.lower() if dot else ""
