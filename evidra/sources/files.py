"""Benchmark files from file services, checked against what is known of them before they are used."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from .live import Answer, Request, Retry, asked, fetch

OSF = "https://api.osf.io/v2/nodes/{node}/files/osfstorage/"


@dataclass(frozen=True)
class Remote:
    """A file and what pins it: its size, its SHA-256, or git's hash of its content."""

    name: str
    url: str
    size: int | None = None
    sha256: str | None = None
    git_blob: str | None = None


def osf_files(node: str, get: Callable[[Request], Answer] = fetch, retry: Retry = Retry()) -> Iterator[Remote]:
    """Every file of a project's storage, folder by folder, page by page."""
    queue, seen = [OSF.format(node=node)], set()
    while queue:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        page = json.loads(asked(Request(url), retry, get)[0])
        for entry in page.get("data", []):
            facts = entry.get("attributes", {})
            if facts.get("kind") == "folder":
                queue.append(entry["relationships"]["files"]["links"]["related"]["href"])
            else:
                yield Remote(facts.get("materialized_path") or facts["name"], entry["links"]["download"], facts.get("size"), ((facts.get("extra") or {}).get("hashes") or {}).get("sha256"))
        following = (page.get("links") or {}).get("next")
        queue += [following] if following else []


def git_blob(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def differences(content: bytes, known: Remote) -> list[str]:
    """In what a file's content is not what was pinned."""
    found = {"size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "git_blob": git_blob(content)}
    return [k for k, v in found.items() if (w := getattr(known, k)) is not None and w != v]


def download(files: list[Remote], folder: str, overwrite: bool = False, get: Callable[[Request], Answer] = fetch, retry: Retry = Retry()) -> list[dict]:
    """Fetch a few files; one that differs from what pins it is not kept, and one that is there and right is not fetched."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for f in files:
        path = Path(folder) / Path(f.name).name
        there = path.exists() and not overwrite and not differences(path.read_bytes(), f)
        if not there:
            content, _ = asked(Request(f.url), retry, get)
            if wrong := differences(content, f):
                raise ValueError(f"{f.name}: {', '.join(wrong)} differ from what is pinned")
            path.write_bytes(content)
        out.append({"name": f.name, "path": str(path), "fetched": not there, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()})
    return out
