"""Replay of a folder of message files into a queue, which can be broken off and taken up again."""

from __future__ import annotations

from surgelight.sinks.files import read_marker, write_marker
from surgelight.sources.queue import FolderClient


def replay(folder: str, client, marker: str) -> int:  # noqa: ANN001
    """Sends every line of the files of ``folder``, in order of their names, headers too, and returns how many were sent.

    ``marker`` names the last file that was sent whole. A file that was broken off is sent again from its beginning, under
    the same name: a folder as queue then has it once, a broker may have lines of it twice. Later files of the folder are
    sent by the next call; a marker that names no file of the folder means from the beginning.
    """
    source = FolderClient({"path": folder})
    names = source._files()
    last = read_marker(marker)
    sent = 0
    for name in names[names.index(last) + 1 if last in names else 0 :]:
        sent += client.publish(name.rsplit("/", 1)[-1], source._lines(name))
        write_marker(marker, name)
    return sent
