"""Signed page cursors without state on the server, and fingerprints of what a request may see."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the key is derived for, the payload's version, and seconds that a cursor lives.
PURPOSE, VERSION, LIFETIME = b"wiki-search-cursor:v1", 1, 600


class CursorError(ValueError):
    """A cursor that wasn't issued for this request, has run out, or was changed."""


def signing_key(secret: str) -> bytes:
    if not secret:
        raise ValueError("a signing secret is needed")
    return hmac.digest(secret.encode(), PURPOSE, "sha256")


def _text(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _raw(text: str) -> bytes:
    """Strict: only the one spelling that ``_text`` gives is taken."""
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except ValueError as e:
        raise CursorError("encoding") from e
    if not text or _text(raw) != text:
        raise CursorError("encoding")
    return raw


def encode(key: bytes, branch: str, binding: dict, state: dict, now: int) -> str:
    payload = {"binding": binding, "branch": branch, "exp": now + LIFETIME, "iat": now, "state": state, "version": VERSION}
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return f"{_text(body)}.{_text(hmac.digest(key, body, 'sha256'))}"


def decode(key: bytes, cursor: str, branch: str, binding: dict, now: int) -> dict:
    """The state of a cursor whose signature, version, branch, binding and time all hold."""
    body, dot, signature = cursor.partition(".")
    if not dot:
        raise CursorError("format")
    raw = _raw(body)
    if not hmac.compare_digest(_raw(signature), hmac.digest(key, raw, "sha256")):
        raise CursorError("signature")
    payload = json.loads(raw)
    for name, wanted in (("version", VERSION), ("branch", branch), ("binding", binding)):
        if payload.get(name) != wanted:
            raise CursorError(name)
    if now >= payload["exp"]:
        raise CursorError("expired")
    return payload["state"]


def scope_fingerprint(user: Column, datasets: Column, documents: Column) -> Column:
    """SHA-256 of the user and the distinct, sorted ids that are in scope; null documents mean no restriction."""

    def ids(a: Column) -> Column:
        return F.array_sort(F.array_distinct(a))

    scope = F.struct(ids(datasets).alias("dataset_ids"), ids(documents).alias("doc_ids"), user.alias("user_id"))
    return F.sha2(F.to_json(scope, {"ignoreNullFields": "false"}), 256)
