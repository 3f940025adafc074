"""Statements over TCP: length-prefixed frames of JSON, a login by challenge, one session for each connection.

Frames are not encrypted: listen on the local host, or put a TLS proxy in front. Spark Connect is the way for bulk
reads; an answer here is one frame at most.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import socket
import socketserver
import struct

from .auth import Users
from .schema import EngineError
from .session import Engine, Result, Session

MAX_FRAME = 16 << 20


def send(sock: socket.socket, message: dict) -> None:
    raw = json.dumps(message, ensure_ascii=False).encode()
    if len(raw) > MAX_FRAME:
        raw = json.dumps({"ok": False, "error": "the answer is larger than a frame: set a LIMIT"}).encode()
    sock.sendall(struct.pack(">I", len(raw)) + raw)


def _exactly(sock: socket.socket, n: int) -> bytes | None:
    out = bytearray()
    while len(out) < n:
        if not (got := sock.recv(min(n - len(out), 1 << 16))):
            return None
        out += got
    return bytes(out)


def receive(sock: socket.socket) -> dict | None:
    """The next message; None when the other side has gone."""
    head = _exactly(sock, 4)
    if head is None:
        return None
    (n,) = struct.unpack(">I", head)
    if n > MAX_FRAME:
        raise EngineError("a frame is too large")
    raw = _exactly(sock, n)
    try:
        found = None if raw is None else json.loads(raw)
    except ValueError as error:
        raise EngineError("a frame is not JSON") from error
    if found is not None and not isinstance(found, dict):
        raise EngineError("a message is an object")
    return found


def _shown(result: Result) -> dict:
    rows, size = [], 0
    if result.rows is not None:
        for row in result.rendered().toLocalIterator():  # a partition at a time, until a frame is full
            rows.append(list(row))
            size += sum(len(x or "") for x in row)
            if size > MAX_FRAME:
                raise EngineError("the answer is larger than a frame: set a LIMIT")
    columns = list(result.rows.columns) if result.rows is not None else []
    return {"ok": True, "columns": columns, "rows": rows, "message": result.message, "affected": result.affected, "error": None}


def answer(session: Session, message: dict) -> dict:
    """The reply to a message: {type: sql, sql: text}, {type: ping} or {type: close}. Errors are replies, too."""
    kind = message.get("type")
    if kind in ("ping", "close"):
        return {"ok": True, "message": "pong" if kind == "ping" else "bye"}
    if kind != "sql" or not isinstance(message.get("sql"), str):
        return {"ok": False, "error": "a message has the type sql, ping or close"}
    try:
        found = [_shown(r) for r in session.script(message["sql"])]
    except EngineError as error:
        return {"ok": False, "error": str(error)}
    return (found[-1] if found else {"ok": True, "columns": [], "rows": [], "message": "", "affected": 0, "error": None}) | {"script": found if len(found) > 1 else None}


def _proof(verifier: bytes, nonce: bytes, user: str) -> bytes:
    return hmac.new(verifier, nonce + user.encode(), hashlib.sha256).digest()


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, engine: Engine, addr: str | None = None):
        if engine.users is None and engine.store.get_text("users.json") is not None:
            raise EngineError("this store has users: open the engine with the administrator's password")
        host, _, port = (addr or engine.config.server_addr).rpartition(":")
        self.engine, self.secret = engine, os.urandom(32)
        super().__init__((host, int(port)), _Connection)

    def challenge(self, user: str) -> tuple[bytes, bytes]:
        """Salt and verifier; unknown users get a steady salt and a verifier that nothing meets."""
        known = self.engine.users.verifiers.get(user)
        return known or (hmac.new(self.secret, user.encode(), hashlib.sha256).digest()[:16], os.urandom(64))


class _Connection(socketserver.BaseRequestHandler):
    def handle(self) -> None:
        try:
            user = self._login()
            if user is None:
                return
            with self.server.engine.session(user) as session:  # a connection that ends rolls back
                while (message := receive(self.request)) is not None:
                    send(self.request, answer(session, message))
                    if message.get("type") == "close":
                        return
        except EngineError as error:
            send(self.request, {"ok": False, "error": str(error)})
        except OSError:
            return

    def _login(self) -> str | None:
        hello = receive(self.request) or {}
        user = str(hello.get("user", ""))
        if self.server.engine.users is None:
            send(self.request, {"ok": True, "login": False})
            return "admin"
        (salt, verifier), nonce = self.server.challenge(user), os.urandom(32)
        send(self.request, {"ok": True, "login": True, "salt": base64.b64encode(salt).decode(), "nonce": base64.b64encode(nonce).decode()})
        reply = receive(self.request) or {}
        try:
            given = base64.b64decode(str(reply.get("proof", "")))
        except ValueError:
            given = b""
        if not hmac.compare_digest(given, _proof(verifier, nonce, user)):
            send(self.request, {"ok": False, "error": "wrong user or password"})
            return None
        send(self.request, {"ok": True})
        return user


class Client:
    def __init__(self, addr: tuple[str, int], user: str = "admin", password: str = ""):
        self.sock = socket.create_connection(addr)
        asked = self._ask({"type": "hello", "user": user})
        if asked.get("login"):
            verifier = Users._hash(password, base64.b64decode(asked["salt"]))
            proof = _proof(verifier, base64.b64decode(asked["nonce"]), user)
            self._ask({"type": "proof", "proof": base64.b64encode(proof).decode()})

    def _ask(self, message: dict) -> dict:
        send(self.sock, message)
        found = receive(self.sock)
        if found is None or not found.get("ok"):
            raise EngineError((found or {}).get("error") or "the server has gone")
        return found

    def sql(self, text: str) -> dict:
        return self._ask({"type": "sql", "sql": text})

    def close(self) -> None:
        try:
            self._ask({"type": "close"})
        finally:
            self.sock.close()
