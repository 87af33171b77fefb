"""Rank files of byte-level BPE vocabularies."""

from __future__ import annotations

import base64
import json

import public_tokenizers
import tiktoken


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer file has ids for besides its vocabulary, such as an end of text."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def encoder(path: str, added: dict[str, int] | None = None) -> tiktoken.Encoding:
    """Texts may be cut at the strings ``added``; without any, such strings are ordinary text."""
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=added or {}
    )
