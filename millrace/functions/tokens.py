"""Signed tokens that name a user, for links in mail."""

from __future__ import annotations

import base64
import binascii
import hmac
from hashlib import sha256


def _mac(user: int, secret: str) -> str:
    return hmac.new(secret.encode(), str(user).encode(), sha256).hexdigest()


def make_token(user: int, secret: str) -> str:
    if not secret or not secret.strip():
        raise ValueError("a token needs a secret")
    return base64.urlsafe_b64encode(f"{int(user)}.{_mac(int(user), secret)}".encode()).decode().rstrip("=")


def read_token(token: str | None, secret: str) -> int | None:
    """The user, or None for a token that is not ours."""
    if not token or not secret or not secret.strip():
        return None
    try:
        user, dot, mac = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode("ascii").partition(".")
    except (binascii.Error, UnicodeError, ValueError):
        return None
    return int(user) if dot and user.isdigit() and hmac.compare_digest(mac, _mac(int(user), secret)) else None
