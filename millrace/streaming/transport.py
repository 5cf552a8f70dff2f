"""A reliable hop between processes over TCP: numbered messages, cumulative acknowledgements, resend after a reconnection, soft close.

A sender numbers its messages from 1 and keeps them until they are acknowledged (at most ``window`` of them; then ``send`` waits).
If the connection breaks, or nothing is acknowledged for ``ack_timeout`` while messages are out, it connects again and sends
what is left, numbered from 1 again. The receiver takes a connection's messages in order only: what it has taken in it acknowledges
when ``window / 2`` messages are not acknowledged yet, when ``ACK_EVERY`` seconds have passed, and at the end. A soft close sends
CLOSE after all messages and waits for the answer, so nothing is lost; a hard close drops what was not acknowledged.

Delivery is at least once: a message whose acknowledgement got lost comes again. ``Receiver`` hands messages to a callback;
``records`` turns them into the lines of a stream with a place each, which a stream source reads (see ``sources.framed``).
"""

from __future__ import annotations

import socket
import struct
import threading
import time
from collections.abc import Callable

from ..functions.codecs import ACK, CLOSE, DATA
from ..sources.memory import ReplayBuffer

# Messages that may be unacknowledged, seconds between acknowledgements, seconds to wait for one, tries and the pause between them.
WINDOW, ACK_EVERY, ACK_TIMEOUT, RETRIES, PAUSE = 20_000, 0.1, 10.0, 100, 1.0
HEADER = struct.Struct("<III")


def packed(command: int, seq: int, payload: bytes = b"") -> bytes:
    """A message: the length of what follows, command, number, payload."""
    return HEADER.pack(8 + len(payload), command, seq) + payload


def _exactly(connection: socket.socket, n: int) -> bytes:
    parts, left = [], n
    while left:
        piece = connection.recv(min(left, 1 << 20))
        if not piece:
            raise ConnectionError("the connection was closed")
        parts.append(piece)
        left -= len(piece)
    return b"".join(parts)


def received(connection: socket.socket) -> tuple[int, int, bytes]:
    """The next message's command, number and payload."""
    length, command, seq = HEADER.unpack(_exactly(connection, HEADER.size))
    if length < 8:
        raise ConnectionError("a message is shorter than its header")
    return command, seq, _exactly(connection, length - 8)


class Sender:
    """The client's side. Use it from one thread; close() or use it as a context."""

    def __init__(self, address: tuple[str, int], window: int = WINDOW, ack_timeout: float = ACK_TIMEOUT, retries: int = RETRIES, pause: float = PAUSE) -> None:
        self.address, self.ack_timeout, self.retries, self.pause = address, ack_timeout, retries, pause
        self.buffer, self.lock = ReplayBuffer(window), threading.Condition()
        self.connection: socket.socket | None = None
        self.broken, self.closed, self.connections, self.heard = False, False, 0, time.monotonic()

    def send(self, payload: bytes) -> int:
        """Sends or, if the window is full, waits for acknowledgements first. Returns the message's number in this connection."""
        self._connected()
        while True:
            with self.lock:
                if len(self.buffer.held) < self.buffer.bound:
                    seq = self.buffer.add(payload)
                    break
            self._wait()
        self._write(packed(DATA, seq, payload))
        return seq

    def flush(self) -> None:
        """Returns when everything is acknowledged."""
        while True:
            self._connected()
            with self.lock:
                if not self.buffer.held:
                    return
            self._wait()

    def close(self, soft: bool = True) -> None:
        """soft: waits until the receiver has everything and says so. Else what is not acknowledged is dropped."""
        if soft and (self.connection or self.buffer.held):
            self.flush()
            self._write(packed(CLOSE, self.buffer.last))
            with self.lock:
                self.lock.wait_for(lambda: self.closed or self.broken, self.ack_timeout)
        self._drop()

    def __enter__(self) -> Sender:
        return self

    def __exit__(self, kind: object, *rest: object) -> None:
        self.close(soft=kind is None)

    # ---- connection

    def _connected(self) -> None:
        """Connects, if there is no good connection, and sends again what was not acknowledged."""
        if self.connection and not self.broken:
            return
        self._drop()
        for tried in range(self.retries):
            try:
                self.connection = socket.create_connection(self.address, self.ack_timeout)
                break
            except OSError:
                if tried + 1 == self.retries:
                    raise
                time.sleep(self.pause)
        self.connection.settimeout(None)
        self.connections += 1
        with self.lock:
            self.broken, self.heard = False, time.monotonic()
            again = self.buffer.renumber()
        threading.Thread(target=self._listen, args=(self.connection,), daemon=True).start()
        for seq, payload in again:
            self._write(packed(DATA, seq, payload))

    def _listen(self, connection: socket.socket) -> None:
        try:
            while True:
                command, seq, _ = received(connection)
                with self.lock:
                    if connection is not self.connection:
                        return
                    self.heard = time.monotonic()
                    if command == ACK:
                        self.buffer.ack(seq)
                    elif command == CLOSE:
                        self.closed = True
                    self.lock.notify_all()
        except (OSError, ValueError):
            with self.lock:
                if connection is self.connection:
                    self.broken = True
                    self.lock.notify_all()

    def _write(self, message: bytes) -> None:
        """A message that can't be written is in the buffer, and is sent again after the next connection."""
        try:
            self.connection.sendall(message)
        except OSError:
            with self.lock:
                self.broken = True

    def _wait(self) -> None:
        """Waits for news; without any for ack_timeout the connection counts as broken."""
        with self.lock:
            self.lock.wait(self.ack_timeout / 4)
            if self.buffer.held and time.monotonic() - self.heard > self.ack_timeout:
                self.broken = True
        self._connected()

    def _drop(self) -> None:
        if self.connection:
            with self.lock:
                connection, self.connection = self.connection, None
            try:
                connection.shutdown(socket.SHUT_RDWR)
            except OSError:
                pass
            connection.close()


class Receiver:
    """The server's side: hands each payload to the callback, in order for each connection. A payload counts as taken when it returns."""

    def __init__(self, take: Callable[[bytes], None], host: str = "127.0.0.1", port: int = 0, window: int = WINDOW, ack_every: float = ACK_EVERY) -> None:
        self.take, self.window, self.ack_every = take, window, ack_every
        self.listening = socket.create_server((host, port))
        self.address = self.listening.getsockname()[:2]
        self.messages, self.acks, self.error, self.stopping = 0, 0, None, False
        self.connections: set[socket.socket] = set()
        self.lock, self.one = threading.Lock(), threading.Lock()
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while not self.stopping:
            try:
                connection, _ = self.listening.accept()
            except OSError:
                return
            with self.lock:
                self.connections.add(connection)
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection: socket.socket) -> None:
        seen, told, lock, ended = [0], [0], threading.Lock(), threading.Event()

        def acknowledge() -> None:
            with lock:
                if seen[0] > told[0]:
                    connection.sendall(packed(ACK, seen[0]))
                    told[0] = seen[0]
                    self.acks += 1

        def tick() -> None:
            while not ended.wait(self.ack_every):
                try:
                    acknowledge()
                except OSError:
                    return

        threading.Thread(target=tick, daemon=True).start()
        try:
            while True:
                command, seq, payload = received(connection)
                if command == CLOSE:
                    acknowledge()
                    connection.sendall(packed(CLOSE, seq))
                    return
                if command != DATA or seq != seen[0] + 1:
                    raise ConnectionError(f"message {seq} follows {seen[0]}")
                with self.one:  # one callback at a time, whatever the number of senders
                    self.take(payload)
                    self.messages += 1
                seen[0] = seq
                if seen[0] - told[0] > self.window // 2:
                    acknowledge()
        except OSError:
            pass
        except Exception as e:  # the callback's error ends the connection; the sender keeps the message
            self.error = e
        finally:
            ended.set()
            with self.lock:
                self.connections.discard(connection)
            connection.close()

    def drop_connections(self) -> None:
        """Breaks all connections; senders connect again."""
        with self.lock:
            held = list(self.connections)
        for connection in held:
            try:
                connection.shutdown(socket.SHUT_RDWR)
            except OSError:
                pass

    def stop(self) -> None:
        """Takes no more connections and ends those that are there."""
        self.stopping = True
        try:
            self.listening.shutdown(socket.SHUT_RDWR)
        except OSError:
            pass
        self.listening.close()
        self.drop_connections()

    def __enter__(self) -> Receiver:
        return self

    def __exit__(self, *error: object) -> None:
        self.stop()
