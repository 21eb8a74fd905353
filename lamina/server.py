"""Statements over TCP, one a message, each in a thread of its connection.

A message is its length (unsigned 64-bit, little-endian) and then its bytes: a statement
in UTF-8 to the server, a MessagePack value back. The value is a map of one key, ``Ok``
with ``[columns, [seconds, nanoseconds]]`` or ``Err`` with a text. A column is
``[[name, type, [nullable, default, codec]], values]``; a value is ``"Null"`` or a map from
its type's name to it. The statement ``exit`` ends a connection.
"""

from __future__ import annotations

import logging
import socketserver
import struct
import sys
import threading
import time
import uuid
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamina.config import Config
from lamina.engine import Engine, Merger
from lamina.errors import LaminaError

LENGTH, MOST_BYTES = struct.Struct("<Q"), 64 << 20
#: The wire's names of Spark types; others are sent as text. Fixed values of the protocol.
NAMES = {T.ByteType(): "Int8", T.ShortType(): "Int16", T.IntegerType(): "Int32", T.LongType(): "Int64", T.DecimalType(20, 0): "UInt64", T.BooleanType(): "Bool", T.StringType(): "String"}
CODEC = {"Zstd": 3}
log = logging.getLogger(__name__)


def pack(value: object) -> bytes:
    """MessagePack of None, booleans, integers of 64 bits, floats, text, bytes, lists and maps."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, (int, Decimal)):
        n = int(value)
        if -32 <= n < 128:
            return struct.pack("b" if n < 0 else "B", n)
        return b"\xd3" + struct.pack(">q", n) if n < 1 << 63 else b"\xcf" + struct.pack(">Q", n)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 32, b"\xda", b"\xdb") + raw
    if isinstance(value, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(value)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(len(value), 0x90, 16, b"\xdc", b"\xdd") + b"".join(map(pack, value))
    if isinstance(value, dict):
        return _head(len(value), 0x80, 16, b"\xde", b"\xdf") + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(f"{type(value).__name__} has no wire form")


def _head(size: int, small: int, limit: int, two: bytes, four: bytes) -> bytes:
    if size < limit:
        return bytes([small | size])
    return two + struct.pack(">H", size) if size < 1 << 16 else four + struct.pack(">I", size)


def answer(df: DataFrame, began: float) -> bytes:
    """The rows of ``df`` as a message. They are gathered here: add LIMIT to statements with large results."""
    rows, columns = df.collect(), []
    for i, field in enumerate(df.schema.fields):
        name = NAMES.get(field.dataType)
        kind, plain = name or "String", name is not None
        values = ["Null" if r[i] is None else {kind: r[i] if plain else str(r[i])} for r in rows]
        columns.append([[field.name, kind, [field.nullable, None, CODEC]], values])
    taken = time.perf_counter() - began
    return pack({"Ok": [columns, [int(taken), int(taken % 1 * 1e9)]]})


class _Connection(socketserver.BaseRequestHandler):
    server: Server

    def _exactly(self, size: int) -> bytes | None:
        out = bytearray()
        while len(out) < size:
            got = self.request.recv(min(size - len(out), 1 << 16))
            if not got:
                return None
            out += got
        return bytes(out)

    def _send(self, body: bytes) -> None:
        self.request.sendall(LENGTH.pack(len(body)) + body)

    def handle(self) -> None:
        with self.server.room:
            while head := self._exactly(LENGTH.size):
                size = LENGTH.unpack(head)[0]
                if size > MOST_BYTES:
                    self._send(pack({"Err": f"a statement of {size} bytes is too long"}))
                    return
                raw = self._exactly(size)
                text = None if raw is None else raw.decode(errors="replace")
                if text is None or text == "exit":
                    return
                self._send(self.server.run(text))


class Server(socketserver.ThreadingTCPServer):
    """Serves one engine; at most ``max_connections`` at once, others wait. ``run`` gives the message for a statement."""

    daemon_threads = allow_reuse_address = True

    def __init__(self, engine: Engine, host: str | None = None, port: int | None = None) -> None:
        config = engine.config
        self.engine, self.room = engine, threading.BoundedSemaphore(config.max_connections)
        super().__init__((host or config.host, config.port if port is None else port), _Connection)

    def run(self, text: str) -> bytes:
        began = time.perf_counter()
        try:
            weight = self.engine.load.enter("select")  # rows are gathered while the answer is made
            try:
                return answer(self.engine.sql(text), began)
            finally:
                self.engine.load.leave(weight)
        except (LaminaError, PySparkException) as e:
            return pack({"Err": f"{type(e).__name__}: {e}"})
        except Exception:  # the connection outlives a fault in one statement
            name = uuid.uuid4().hex
            log.exception("internal error %s", name)
            return pack({"Err": f"internal error {name}, see the log"})


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    config = Config.load()
    engine = Engine(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else config.root, config)
    merger = Merger(engine)
    merger.start()
    with Server(engine) as server:
        log.info("listening on %s:%s", *server.server_address)
        try:
            server.serve_forever()
        finally:
            merger.stop()


if __name__ == "__main__":
    main()
