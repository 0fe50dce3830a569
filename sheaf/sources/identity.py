"""Who asks: passwords of documents, secrets of keys and tokens, and the session's own token.

Secrets and passwords are kept as salted digests, in the memory of the catalog. This decides who a session is; it is no
wall around the files, which only the storage itself can guard.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time

Instance = tuple[str, object]


def _digest(salt: bytes, secret: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, 50_000)


class Identity:
    def __init__(self):
        self.passwords: dict[Instance, tuple[bytes, bytes]] = {}
        self.keys: dict[str, tuple[str, str | None]] = {}  # by the secret's digest: name and role
        self.tokens: dict[str, tuple[str, Instance]] = {}  # by the secret's digest: token and whose it is
        self.token: str | None = None
        self.who: Instance | None = None
        self._sign = secrets.token_bytes(32)

    @staticmethod
    def _plain(secret: str) -> str:
        return hashlib.sha256(secret.encode()).hexdigest()

    def set_password(self, who: Instance, password: str) -> None:
        salt = secrets.token_bytes(16)
        self.passwords[who] = (salt, _digest(salt, password))

    def verify(self, who: Instance, password: str) -> bool:
        salt, known = self.passwords.get(who, (b"", b""))
        return hmac.compare_digest(_digest(salt, password), known) if known else False

    def new_key(self, name: str, role: str | None) -> str:
        secret = secrets.token_urlsafe(30)
        self.keys[self._plain(secret)] = (name, role)
        return secret

    def key_of(self, secret: str) -> tuple[str, str | None] | None:
        return self.keys.get(self._plain(secret))

    def login(self, who: Instance) -> tuple[str, str]:
        """(token, secret)"""
        token, secret = secrets.token_hex(8), secrets.token_urlsafe(30)
        self.tokens[self._plain(secret)] = (token, who)
        return token, secret

    def use(self, secret: str | None) -> None:
        """The session goes on with a token; None ends that."""
        self.token, self.who = self.tokens[self._plain(secret)] if secret else (None, None)

    def logout(self, everywhere: bool) -> list[str]:
        """Tokens that are void now: the session's, or all of its identity."""
        gone = [h for h, (t, w) in self.tokens.items() if w == self.who and (everywhere or t == self.token)] if self.who else []
        out = [self.tokens.pop(h)[0] for h in gone]
        self.token = self.who = None
        return out

    def jwt(self, who: Instance, seconds: int) -> str:
        part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).rstrip(b"=")
        body = part({"alg": "HS256", "typ": "JWT"}) + b"." + part({"sub": f"{who[0]}/{who[1]}", "exp": int(time.time()) + seconds})
        return (body + b"." + base64.urlsafe_b64encode(hmac.new(self._sign, body, hashlib.sha256).digest()).rstrip(b"=")).decode()
