"""Writing reports: in one step, and nowhere else than beneath the root."""

import os

import pytest

from driftgauge.sources import output
from driftgauge.sources.output import OutputError, write


def left(folder):
    return sorted(os.listdir(folder))


def test_replaces_in_one_step(tmp_path):
    (tmp_path / "sub").mkdir()
    for root in (None, str(tmp_path)):
        write(str(tmp_path / "sub/r.txt"), [b"one ", b"two"], root)
        assert (tmp_path / "sub/r.txt").read_bytes() == b"one two" and left(tmp_path / "sub") == ["r.txt"]

    def fails():
        yield b"half"
        raise OSError(28, "No space left")

    with pytest.raises(OutputError, match="No space"):
        write(str(tmp_path / "sub/r.txt"), fails(), str(tmp_path))
    assert (tmp_path / "sub/r.txt").read_bytes() == b"one two" and left(tmp_path / "sub") == ["r.txt"]


def test_stays_beneath_the_root(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "out", tmp_path / "in/link")
    os.symlink(tmp_path / "in", tmp_path / "alias")
    for bad in ("out/x", "in/../out/x", "in/link/x", "in", "in/none/x"):
        with pytest.raises(OutputError):
            write(str(tmp_path / bad), [b"x"], str(tmp_path / "in"))
    write(str(tmp_path / "alias/y"), [b"y"], str(tmp_path / "alias"))
    os.symlink(tmp_path / "out/z", tmp_path / "in/z")
    write(str(tmp_path / "in/z"), [b"z"], str(tmp_path / "in"))  # the link itself is replaced
    assert left(tmp_path / "out") == [] and left(tmp_path / "in") == ["link", "y", "z"] and not os.path.islink(tmp_path / "in/z")


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_swapped_parent_redirects_nothing(tmp_path, monkeypatch, moment):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "out").mkdir()

    def swap():
        os.rename(tmp_path / "in/a", tmp_path / "in/b")
        os.symlink(tmp_path / "out", tmp_path / "in/a")

    def parts():
        if moment == "before":
            swap()
        yield b"text"

    real = os.replace

    def replace(*a, **k):
        if moment == "after":
            swap()
        return real(*a, **k)

    monkeypatch.setattr(output.os, "replace", replace)
    with pytest.raises(OutputError, match="changed"):
        write(str(tmp_path / "in/a/r.txt"), parts(), str(tmp_path / "in"))
    assert left(tmp_path / "out") == [] and [n for n in left(tmp_path / "in/b") if n.endswith(".tmp")] == []


def test_a_swapped_temporary_is_not_used(tmp_path):
    def parts():
        yield b"good"
        (name,) = [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
        os.unlink(tmp_path / name)
        (tmp_path / name).write_bytes(b"bad")

    with pytest.raises(OutputError, match="temporary"):
        write(str(tmp_path / "r.txt"), parts(), str(tmp_path))
    assert not (tmp_path / "r.txt").exists()
