"""Writing a file in one step. Beneath a root, every directory on the way is held open, so that one swapped meanwhile redirects nothing."""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterable

from driftgauge.sources import paths as P


class OutputError(OSError):
    pass


class Chain:
    """The directories from a root down to the one that is written in, each opened from the one above."""

    def __init__(self, root: str, rel: str):
        self.root, self.names, self.open = root, P.parts_of(rel), []
        try:
            self.open.append(os.open(root, P.DIRECTORY))
            for name in self.names:
                self.open.append(os.open(name, P.DIRECTORY, dir_fd=self.open[-1]))
            self.check()
        except OSError as e:
            self.close()
            raise e if isinstance(e, OutputError) else OutputError(f"the output's directories must be real ones beneath the root: {e.strerror}") from e

    @property
    def last(self) -> int:
        return self.open[-1]

    def check(self) -> None:
        """The names still lead to what is open."""
        try:
            same = [os.path.samestat(os.lstat(self.root), os.fstat(self.open[0]))]
            same += [os.path.samestat(os.stat(name, dir_fd=above, follow_symlinks=False), os.fstat(fd)) for name, above, fd in zip(self.names, self.open, self.open[1:], strict=False)]
        except OSError:
            same = [False]
        if not all(same):
            raise OutputError("an output directory changed while it was in use")

    def close(self) -> None:
        while self.open:
            os.close(self.open.pop())


def write(path: str, parts: Iterable[bytes], root: str | None = None) -> None:
    """Replace a file by what the parts make together, synced before it takes the name. Other writers' files, and the old one where anything
    fails, stay as they are. With a root the file must lie beneath it, and no link leads to it."""
    full = os.path.abspath(path)
    base = os.path.realpath(root) if root is not None else os.path.realpath(os.path.dirname(full))
    if root is None:
        full = os.path.join(base, os.path.basename(full))
    elif not full.startswith(os.path.join(base, "")):
        top = os.path.abspath(root)
        if not full.startswith(os.path.join(top, "")):
            raise OutputError("the output must be a file beneath the root")
        full = os.path.join(base, os.path.relpath(full, top))
    folder, name = os.path.split(os.path.relpath(full, base))
    chain = Chain(base, folder)
    temp, own = None, None
    try:
        temp = f".{name}.{secrets.token_hex(8)}.tmp"
        fd = os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_CLOEXEC", 0), 0o600, dir_fd=chain.last)
        own = os.fstat(fd)
        with os.fdopen(fd, "wb") as f:
            for part in parts:
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        chain.check()
        if not os.path.samestat(os.stat(temp, dir_fd=chain.last, follow_symlinks=False), own):
            raise OutputError("the temporary output changed before it took its name")
        os.replace(temp, name, src_dir_fd=chain.last, dst_dir_fd=chain.last)
        temp = None
        chain.check()
    except OutputError:
        raise
    except OSError as e:
        raise OutputError(f"the output could not be written: {e.strerror or e}") from e
    finally:
        if temp is not None and own is not None:
            try:
                if os.path.samestat(os.stat(temp, dir_fd=chain.last, follow_symlinks=False), own):
                    os.unlink(temp, dir_fd=chain.last)
            except OSError:
                pass
        chain.close()
