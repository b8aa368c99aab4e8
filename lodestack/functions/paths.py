"""Paths: containment and normal form."""

from __future__ import annotations

import posixpath


def is_within(outer: str, inner: str) -> bool:
    """Whether ``inner`` lies strictly below ``outer``."""
    a, b = posixpath.normpath(outer), posixpath.normpath(inner)
    return a != b and posixpath.relpath(b, a).split("/")[0] != ".." and posixpath.isabs(a) == posixpath.isabs(b)


def normalise(path: str) -> str:
    """A relative path without leading steps up; a path of nothing is refused."""
    clean = posixpath.normpath(path.strip()).lstrip("/")
    while clean.startswith("../"):
        clean = clean[3:]
    if clean in ("", ".", ".."):
        raise ValueError("invalid path")
    return clean
