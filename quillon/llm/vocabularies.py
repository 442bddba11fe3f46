"""Where the public vocabularies are; they are never copied into the repository."""

from __future__ import annotations


def vocabulary_path(name: str) -> str:
    """The file of a vocabulary in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
