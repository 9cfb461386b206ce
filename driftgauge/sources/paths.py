"""Opening what lies beneath a root one component at a time: no link is followed on the way, and what is read is what was opened."""

from __future__ import annotations

import os
import stat

_COMMON = os.O_RDONLY | getattr(os, "O_CLOEXEC", 0) | getattr(os, "O_NOFOLLOW", 0)
DIRECTORY, FILE = _COMMON | getattr(os, "O_DIRECTORY", 0), _COMMON | getattr(os, "O_NONBLOCK", 0)


class Unsafe(OSError):
    """What is there is not what may be read: a link, no regular file, something changed, or too much."""


class TooLarge(Unsafe):
    pass


def parts_of(rel: str) -> list[str]:
    """The components of a path beneath a root; Unsafe where it could leave it."""
    parts = [p for p in rel.split("/") if p not in ("", ".")]
    if rel.startswith("/") or ".." in parts:
        raise Unsafe(f"{rel}: outside the root")
    return parts


def open_directory(root: str, rel: str = "") -> int:
    """A descriptor of a directory beneath the root, reached by real directories alone; the root itself may be a link."""
    fd = os.open(root, DIRECTORY & ~getattr(os, "O_NOFOLLOW", 0))
    try:
        for part in parts_of(rel):
            inner = os.open(part, DIRECTORY, dir_fd=fd)
            os.close(fd)
            fd = inner
    except BaseException:
        os.close(fd)
        raise
    return fd


def open_file(root: str, rel: str) -> int:
    """A descriptor of a file beneath the root."""
    *above, name = parts_of(rel)
    folder = open_directory(root, "/".join(above))
    try:
        return os.open(name, FILE, dir_fd=folder)
    finally:
        os.close(folder)


def read_open(fd: int, most: int, seen: os.stat_result | None = None) -> bytes:
    """All bytes of an open regular file, at most so many; with seen, it must be the file that was looked at before."""
    own = os.fstat(fd)
    if not stat.S_ISREG(own.st_mode):
        raise Unsafe("not a regular file")
    if seen is not None and not os.path.samestat(own, seen):
        raise Unsafe("changed while it was being read")
    if own.st_size > most:
        raise TooLarge(f"larger than {most} bytes")
    out = bytearray()
    while len(out) <= most:
        more = os.read(fd, min(1 << 20, most + 1 - len(out)))
        if not more:
            return bytes(out)
        out += more
    raise TooLarge(f"larger than {most} bytes")


def read(root: str, rel: str, most: int) -> bytes:
    fd = open_file(root, rel)
    try:
        return read_open(fd, most)
    finally:
        os.close(fd)


def resolved(root: str, rel: str) -> str:
    """The path beneath the root that a file's own links lead to; Unsafe where they lead out of it or nowhere."""
    try:
        real = os.path.realpath(os.path.join(root, rel), strict=True)
    except OSError as e:
        raise Unsafe("a link that leads nowhere") from e
    if not real.startswith(os.path.join(root, "")):
        raise Unsafe("a symbolic link leads out of the root")
    return os.path.relpath(real, root)


def first_link(root: str, rel: str) -> str | None:
    """The first component of a path that is a link, as a path beneath the root."""
    at = ""
    for part in parts_of(rel):
        at = f"{at}/{part}" if at else part
        if os.path.islink(os.path.join(root, at)):
            return at
    return None
