"""Users and grants."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os

from .schema import EngineError, checked_name

ADMIN = "admin"
PRIVILEGES = ("admin", "read", "write")


class Users:
    """Password verifiers and, for each user, privileges by database or *. Admin implies neither read nor write."""

    def __init__(self, admin_password: str | None = None, password_min_len: int = 8):
        self.min_len = password_min_len
        self.verifiers: dict[str, tuple[bytes, bytes]] = {}
        self.grants: dict[str, dict[str, set[str]]] = {}
        if admin_password is not None:
            self.create(ADMIN, admin_password)
            self.grants[ADMIN]["*"] = set(PRIVILEGES)

    def _verifier(self, password: str) -> tuple[bytes, bytes]:
        if len(password) < self.min_len:
            raise EngineError(f"passwords have {self.min_len} characters or more")
        salt = os.urandom(16)
        return salt, self._hash(password, salt)

    @staticmethod
    def _hash(password: str, salt: bytes) -> bytes:
        return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1)

    def create(self, name: str, password: str, if_not_exists: bool = False) -> bool:
        name = checked_name(name)
        if name in self.verifiers:
            if if_not_exists:
                return False
            raise EngineError(f"user {name} exists")
        self.verifiers[name], self.grants[name] = self._verifier(password), {}
        return True

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name == ADMIN:
            raise EngineError("admin cannot be dropped")
        if name not in self.verifiers:
            if if_exists:
                return False
            raise EngineError(f"no user {name}")
        del self.verifiers[name], self.grants[name]
        return True

    def alter(self, name: str, password: str) -> None:
        if name not in self.verifiers:
            raise EngineError(f"no user {name}")
        self.verifiers[name] = self._verifier(password)

    def verify(self, name: str, password: str) -> bool:
        salt, known = self.verifiers.get(name, (b"\0" * 16, b""))  # unknown users take as long
        return hmac.compare_digest(self._hash(password, salt), known)

    def grant(self, name: str, privileges, on: str) -> None:
        if name not in self.verifiers:
            raise EngineError(f"no user {name}")
        self.grants[name].setdefault(on, set()).update(privileges)

    def revoke(self, name: str, privileges, on: str) -> None:
        own = self.grants.get(name, {})
        own.get(on, set()).difference_update(privileges)
        if on in own and not own[on]:
            del own[on]

    def dump(self) -> str:
        coded = {n: [base64.b64encode(x).decode() for x in pair] for n, pair in self.verifiers.items()}
        return json.dumps({"verifiers": coded, "grants": {n: {on: sorted(ps) for on, ps in own.items()} for n, own in self.grants.items()}})

    @classmethod
    def load(cls, text: str, password_min_len: int = 8) -> Users:
        raw, users = json.loads(text), cls(None, password_min_len)
        users.verifiers = {n: tuple(map(base64.b64decode, pair)) for n, pair in raw["verifiers"].items()}
        users.grants = {n: {on: set(ps) for on, ps in own.items()} for n, own in raw["grants"].items()}
        return users

    def forget_db(self, db: str) -> None:
        for own in self.grants.values():
            own.pop(db, None)

    def allowed(self, name: str, privilege: str, on: str) -> bool:
        own = self.grants.get(name, {})
        return privilege in own.get(on, ()) or privilege in own.get("*", ())

    def shown(self, name: str) -> list[str]:
        return [f"GRANT {', '.join(p.upper() for p in sorted(ps))} ON {on} TO {name}" for on, ps in sorted(self.grants.get(name, {}).items())]
