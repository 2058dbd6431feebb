"""Extractors, embedders and page engines by name. The defaults need no network and give the same result each time."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import tempfile
from collections.abc import Callable

EXTRACTORS: dict[str, Callable] = {}
EMBEDDERS: dict[str, Callable] = {}
PAGE_ENGINES: dict[str, Callable[[bytes], list[str]]] = {}
ANSWERERS: dict[str, Callable[..., Callable[[str, list[str]], str]]] = {}


def register(kind: dict, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        kind[name] = f
        return f

    return add


def get(kind: dict, name: str):
    if name not in kind:
        raise KeyError(f"no provider {name!r}; there are {sorted(kind)}")
    return kind[name]


@register(EXTRACTORS, "gazetteer")
def gazetteer(terms: dict[str, str]) -> Callable[[str, str], dict]:
    """An extractor that finds known names (name -> label), whole words in any case, and quotes where they stand."""
    found = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")(?!\w)", re.I) if terms else None
    low = {k.lower(): (k, v) for k, v in terms.items()}

    def extract(chunk_id: str, text: str) -> dict:
        names = dict.fromkeys(low[m[1].lower()] for m in found.finditer(text)) if found else {}
        return {"nodes": [{"id": name, "label": label, "properties": {"name": name}} for name, label in names], "relationships": []}

    return extract


@register(EXTRACTORS, "prompted")
def prompted(complete: Callable[[str], str], lead: str = "") -> Callable[[str, str], dict]:
    """An extractor by a model: ``complete`` answers a prompt with the JSON of a record, perhaps with words around it."""

    def extract(chunk_id: str, text: str) -> dict:
        answer = complete(lead + text)
        found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
        return {"nodes": found.get("nodes") or [], "relationships": found.get("relationships") or []}

    return extract


@register(EMBEDDERS, "hashed")
def hashed(dimensions: int = 384, n: int = 3) -> Callable[[str], list[float]]:
    """An embedder by hashed character n-grams (the digest's first 15 hex digits give the place and the sign), of length one."""

    def embed(text: str) -> list[float]:
        out = [0.0] * dimensions
        padded = f" {text.lower()} "
        for i in range(len(padded) - n + 1):
            h = int(hashlib.md5(padded[i : i + n].encode()).hexdigest()[:15], 16)
            out[h % dimensions] += 1.0 if h // dimensions % 2 else -1.0
        size = sum(x * x for x in out) ** 0.5
        return [x / size for x in out] if size else out

    return embed


@register(EMBEDDERS, "remote")
def remote(call: Callable[[list[str]], list[list[float]]]) -> Callable[[str], list[float]]:
    """An embedder by a service that takes a list of texts."""
    return lambda text: call([text])[0]


@register(ANSWERERS, "quoting")
def quoting(most: int = 200) -> Callable[[str, list[str]], str]:
    """An answerer that quotes the first characters of each context, numbered."""
    return lambda question, contexts: "\n".join(f"[{k + 1}] {c[:most]}" for k, c in enumerate(contexts))


@register(PAGE_ENGINES, "text")
def text_pages(content: bytes) -> list[str]:
    """Pages of text that has been extracted already, parted by form feeds."""
    pages = content.decode("utf-8", "replace").split("\f")
    return pages[:-1] if len(pages) > 1 and not pages[-1].strip() else pages


@register(PAGE_ENGINES, "poppler")
def poppler(content: bytes, timeout: int = 600) -> list[str]:
    """Pages of a PDF by the pdftotext program, in its layout."""
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        run = subprocess.run(["pdftotext", "-layout", f.name, "-"], capture_output=True, timeout=timeout, check=True)
    return text_pages(run.stdout)


@register(PAGE_ENGINES, "pdfplumber")
def plumber(content: bytes) -> list[str]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


@register(PAGE_ENGINES, "pypdf")
def pypdf_pages(content: bytes) -> list[str]:
    import io

    import pypdf

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]
