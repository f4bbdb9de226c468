"""Viewer addresses of shared files as addresses of their content, and what went wrong with a download."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlparse, urlunparse

SUPPORTED = (".csv", ".tsv", ".txt", ".json", ".ndjson", ".parquet", ".xlsx", ".xlsm")


def raw_url(url: str) -> str:
    """The address that serves the file itself; others stay as they are."""
    u = urlparse(url.strip())
    host, path, query = u.netloc.lower(), u.path, parse_qs(u.query)
    if host == "github.com" and (m := re.match(r"^/([^/]+)/([^/]+)/(?:blob|raw)/(.+)$", path)):
        return f"https://raw.githubusercontent.com/{m[1]}/{m[2]}/{m[3]}"
    if host == "gist.github.com" and not path.endswith("/raw"):
        return f"https://gist.githubusercontent.com{path}/raw"
    if host.endswith("gitlab.com"):
        return urlunparse(u._replace(path=path.replace("/-/blob/", "/-/raw/")))
    if host.endswith("bitbucket.org"):
        return urlunparse(u._replace(path=path.replace("/src/", "/raw/")))
    if host == "huggingface.co":
        return urlunparse(u._replace(path=path.replace("/blob/", "/resolve/")))
    if host == "docs.google.com" and (m := re.match(r"^/spreadsheets/d/([^/]+)", path)):
        gid = query.get("gid", [re.sub(r"\D", "", u.fragment) or "0"])[0]
        return f"https://docs.google.com/spreadsheets/d/{m[1]}/export?format=csv&gid={gid}"
    if host == "drive.google.com" and (m := re.match(r"^/file/d/([^/]+)", path)):
        return f"https://drive.google.com/uc?export=download&id={m[1]}"
    if host.endswith("dropbox.com"):
        return urlunparse(u._replace(query="dl=1"))
    if host.endswith(("1drv.ms", "onedrive.live.com")):
        return urlunparse(u._replace(query="&".join(x for x in (u.query, "download=1") if x)))
    return url


def unsupported(url: str) -> str | None:
    """The suffix, if it is one that cannot be read."""
    m = re.search(r"\.[A-Za-z0-9]+$", urlparse(url).path)
    return m[0].lower() if m and m[0].lower() not in SUPPORTED else None


def http_problem(status: int) -> str | None:
    if status < 400:
        return None
    return {401: "not signed in", 403: "not shared", 404: "not found", 429: "too many requests"}.get(status, "server error" if status >= 500 else "request refused")


def is_html(head: bytes) -> bool:
    """A page in place of a file."""
    return head.lstrip()[:15].lower().startswith((b"<!doctype html", b"<html"))
