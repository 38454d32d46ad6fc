"""Language models for the judge, and fetching of files: both through what the caller allows."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterable


def http_model(url: str, name: str, max_tokens: int = 1024, timeout: float = 120.0, opener: Callable = urllib.request.urlopen) -> Callable[[str], str]:
    """A function prompt -> answer over a chat-completions address; greedy; an empty answer falls back to its reasoning."""

    def ask(prompt: str) -> str:
        body = {"model": name, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max(64, max_tokens)}
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with opener(request, timeout=timeout) as answer:
            message = json.load(answer)["choices"][0]["message"]
        return message.get("content") or message.get("reasoning_content") or ""

    return ask


def unique(urls: Iterable[str]) -> list[str]:
    """Addresses in order, each once, blanks left out."""
    return list(dict.fromkeys(u.strip() for u in urls if u.strip()))


def fetch(url: str, target: str, valid: Callable[[str], bool], opener: Callable = urllib.request.urlopen) -> bool:
    """Fetch a file unless a valid one is there: into a part file that takes the name only once it is valid. True if fetched."""
    if os.path.exists(target) and valid(target):
        return False
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = f"{target}.part"
    with opener(url) as source, open(part, "wb") as sink:
        while chunk := source.read(1 << 20):
            sink.write(chunk)
    if not valid(part):
        os.remove(part)
        raise ValueError(f"{url} gave no valid file")
    os.replace(part, target)
    return True


def is_gzip(path: str, least: int = 1) -> bool:
    """Magic bytes and size of a gzip file."""
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b" and os.path.getsize(path) >= least
