"""Lines from a local socket, kept in files that a stream reads and can read again.

A socket gives each byte once, so a stream straight from it can't be replayed.
``Spool`` runs beside whatever writes to the socket, one process a socket, and
puts whole lines into files of bounded size under a folder; a file appears when
it is complete. ``sources.flows_from_files`` reads the folder with a checkpoint,
any number of times.
"""

from __future__ import annotations

import os
import socket
import threading
import uuid

from netquilt.sources.captures import opened

#: Bytes of a spooled file, about.
FILE = 16 << 20


class Spool:
    """Accepts connections on a UNIX socket path or a ``(host, port)``, one after another, and writes their lines to ``folder``.

    A line goes on from one ``recv`` to the next, not from one connection to
    the next; what a connection leaves without a line end is a line. After
    ``stop`` the connections that are there or wait are still read to their end,
    as their lines would be lost otherwise.
    """

    def __init__(self, where: str | tuple[str, int], folder: str, size: int = FILE):
        self.where, self.folder, self.size = where, folder, size
        self._stop = threading.Event()
        self._begun = f"{uuid.uuid4().hex[:12]}"
        self._files = 0
        if isinstance(where, str):
            if os.path.exists(where):
                os.unlink(where)
            self._socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        else:
            self._socket = socket.socket(socket.AF_INET, socket.SOCK_STREAM)
            self._socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self._socket.bind(where)
        self._socket.listen(1)
        self._socket.settimeout(0.2)
        self.address = self._socket.getsockname()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            while True:
                try:
                    connection, _ = self._socket.accept()
                except TimeoutError:
                    if self._stop.is_set():
                        return
                    continue
                with connection:
                    self._connection(connection)
        finally:
            self._socket.close()
            if isinstance(self.where, str) and os.path.exists(self.where):
                os.unlink(self.where)

    def _connection(self, connection: socket.socket) -> None:
        connection.settimeout(None)
        held = b""
        while data := connection.recv(min(1 << 16, self.size)):
            held += data
            if len(held) >= self.size and (cut := held.rfind(b"\n") + 1):
                self._write(held[:cut])
                held = held[cut:]
        if held:
            self._write(held)

    def _write(self, data: bytes) -> None:
        store, base = opened(self.folder)
        store.create_dir(base, recursive=True)
        temp = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            out.write(data)
        store.move(temp, f"{base}/{self._begun}-{self._files:08d}.json")
        self._files += 1

    def stop(self, timeout: float | None = 30) -> None:
        """Returns when no connection is left, or after ``timeout`` seconds."""
        self._stop.set()
        self._thread.join(timeout)
