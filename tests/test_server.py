"""The TCP server: frames, rows, errors, and several connections."""

from __future__ import annotations

import socket
import struct
import threading
from decimal import Decimal

import pytest

from lamina.config import Config
from lamina.engine import Engine
from lamina.server import MOST_BYTES, Server, pack


def unpack(data: bytes):
    """A small MessagePack reader of its own."""

    def one(at: int):
        b = data[at]
        if b < 0x80:
            return b, at + 1
        if b >= 0xE0:
            return b - 256, at + 1
        if b < 0x90:
            return pairs(b & 15, at + 1)
        if b < 0xA0:
            return items(b & 15, at + 1)
        if b < 0xC0:
            return text(b & 31, at + 1)
        simple = {0xC0: None, 0xC2: False, 0xC3: True}
        if b in simple:
            return simple[b], at + 1
        kind, size = {0xC6: (">I", 4), 0xCB: (">d", 8), 0xCF: (">Q", 8), 0xD3: (">q", 8), 0xDA: (">H", 2), 0xDB: (">I", 4), 0xDC: (">H", 2), 0xDD: (">I", 4), 0xDE: (">H", 2), 0xDF: (">I", 4)}[b]
        n, at = struct.unpack_from(kind, data, at + 1)[0], at + 1 + size
        if b == 0xC6:
            return data[at : at + n], at + n
        if b in (0xDA, 0xDB):
            return text(n, at)
        if b in (0xDC, 0xDD):
            return items(n, at)
        return pairs(n, at) if b in (0xDE, 0xDF) else (n, at)

    def text(n, at):
        return data[at : at + n].decode(), at + n

    def items(n, at):
        out = []
        for _ in range(n):
            v, at = one(at)
            out.append(v)
        return out, at

    def pairs(n, at):
        flat, at = items(2 * n, at)
        return dict(zip(flat[::2], flat[1::2])), at

    value, end = one(0)
    assert end == len(data)
    return value


@pytest.mark.parametrize(
    "value",
    [None, True, False, 0, 127, 128, -1, -32, -33, 2**63 - 1, -(2**63), 2**64 - 1, 1.5, "", "é" * 31, "x" * 70_000, b"\x00\xff", [], list(range(20)), [0] * 70_000, {"a": 1}, {str(i): i for i in range(40)}],
)
def test_wire_form(value):
    assert unpack(pack(value)) == value
    assert unpack(pack(Decimal(2**64 - 1))) == 2**64 - 1


class Client:
    def __init__(self, address):
        self.sock = socket.create_connection(address, timeout=120)

    def exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (got := self.sock.recv(n - len(out))):
            out += got
        return out

    def ask(self, text: str):
        raw = text.encode()
        self.sock.sendall(struct.pack("<Q", len(raw)) + raw)
        return unpack(self.exactly(struct.unpack("<Q", self.exactly(8))[0]))


@pytest.fixture
def server(spark, tmp_path):
    with Server(Engine(spark, f"file://{tmp_path}/root", Config(max_connections=2)), port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield s
        s.shutdown()


def test_statements(server):
    client = Client(server.server_address)
    columns, taken = client.ask("CREATE DATABASE db")["Ok"]
    assert columns[0][0][0] == "OK" and columns[0][1] == [{"String": "OK"}] and len(taken) == 2
    client.ask("CREATE TABLE db.t (id UInt64, name String, small Int8, ok Bool) ORDER BY id")
    client.ask("INSERT INTO db.t (id, name, small, ok) VALUES (18446744073709551615, 'é', -5, TRUE), (1, NULL, NULL, FALSE)")
    columns, _ = client.ask("SELECT * FROM db.t ORDER BY id")["Ok"]
    assert [c[0][:2] for c in columns] == [["id", "UInt64"], ["name", "String"], ["small", "Int8"], ["ok", "Bool"]]
    assert [c[1] for c in columns] == [[{"UInt64": 1}, {"UInt64": 2**64 - 1}], ["Null", {"String": "é"}], ["Null", {"Int8": -5}], [{"Bool": False}, {"Bool": True}]]
    assert client.ask("SELECT 1.5D AS x")["Ok"][0][0][1] == [{"String": "1.5"}]
    assert "Err" in client.ask("SELECT nope FROM db.t") and "Err" in client.ask("DELETE FROM db.t") and "Err" in client.ask("")
    assert "Ok" in client.ask("SELECT 1 AS one")
    client.sock.sendall(struct.pack("<Q", 4) + b"exit")
    assert client.exactly(8) == b""


def test_frames_in_pieces_and_too_long_ones(server):
    client = Client(server.server_address)
    frame = struct.pack("<Q", 15) + b"SELECT 1 AS one"
    for i in range(0, len(frame), 5):
        client.sock.sendall(frame[i : i + 5])
    assert "Ok" in unpack(client.exactly(struct.unpack("<Q", client.exactly(8))[0]))
    client.sock.sendall(struct.pack("<Q", MOST_BYTES + 1))
    assert "too long" in unpack(client.exactly(struct.unpack("<Q", client.exactly(8))[0]))["Err"]
    assert client.exactly(8) == b""


def test_connections_at_once(server):
    one, two, three = (Client(server.server_address) for _ in range(3))
    assert "Ok" in one.ask("SELECT 1 AS x") and "Ok" in two.ask("SELECT 2 AS x")
    one.sock.close()
    assert three.ask("SELECT 3 AS x")["Ok"][0][0][1] == [{"Int32": 3}]
