"""Accounts: names and the hashes of their keys. A key is shown once, when it is made; there is no default key."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
from pathlib import Path

from tidemark.control.config import save_yaml


def new_key() -> str:
    return base64.urlsafe_b64encode(secrets.token_bytes(32)).decode()


def key_hash(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def load(path: str | Path) -> dict[str, str]:
    """{key hash: name}; a missing file has no accounts."""
    import yaml

    p = Path(path)
    return dict((yaml.safe_load(p.read_text()) or {}).get("accounts", {})) if p.exists() else {}


def add(path: str | Path, name: str) -> str:
    """Make an account and return its key."""
    accounts = load(path)
    if not name or name in accounts.values():
        raise ValueError(f"no new account {name!r}")
    key = new_key()
    save_yaml({"accounts": {**accounts, key_hash(key): name}}, path)
    return key


def owner(accounts: dict[str, str], key: str) -> str | None:
    """The name of the account that a key belongs to."""
    given = key_hash(key)
    return next((name for held, name in accounts.items() if hmac.compare_digest(held, given)), None)


def allowed(accounts: dict[str, str], name: str, key: str) -> bool:
    return owner(accounts, key) == name and bool(name)
