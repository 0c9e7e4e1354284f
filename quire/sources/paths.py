"""Containment of paths that users name, checked on the driver before Spark reads or writes them."""

from __future__ import annotations

import os


def resolve_within(root: str, path: str) -> str:
    """The real path of `path` below `root`. Raises ValueError for NUL bytes and for paths that lead outside,
    links included."""
    if "\0" in path:
        raise ValueError("a path must not contain NUL")
    base = os.path.realpath(root)
    real = os.path.realpath(os.path.join(base, path))
    if real != base and not real.startswith(base.rstrip(os.sep) + os.sep):
        raise ValueError(f"path leads outside the root: {path}")
    return real


def readable_file(root: str, path: str) -> str:
    real = resolve_within(root, path)
    if not os.path.isfile(real):
        raise ValueError(f"not a regular file: {path}")
    return real


def split_name(template: str, number: int, spec: str) -> str:
    """An output name: %d is the part's number, %s its page range with anything but letters, digits and - as _."""
    safe = "".join(c if c.isalnum() or c == "-" else "_" for c in spec)
    return template.replace("%d", str(number)).replace("%s", safe)
