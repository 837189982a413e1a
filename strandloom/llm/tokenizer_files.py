"""Where the public vocabulary files lie. They are never copied into the repository."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
