"""Deterministic stand-ins behind the model seams, and the choice of a backend.

Every seam is a plain callable that an executor can load once: an embedder (documents and queries apart), an
extractor, a judge of name matches, a sentence renderer, a query planner and an answerer, and the photo models.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from quillon.schemas import TAG_LABELS

# What each role may be served by.
BACKENDS = ("offline", "local", "hosted")
ROLES = ("text", "vision", "embedding")


class BagEmbedder:
    """L2-normalised hashed bag of words; queries and documents share it, but go through two methods."""

    def __init__(self, dims: int = 32) -> None:
        self.dims = dims

    def embed_docs(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._one(text)

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dims
        for w in re.findall(r"\w+", (text or "").lower()):
            v[zlib.crc32(w.encode()) % self.dims] += 1.0
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else v


def rule_extractor(prompt: str, escalated: bool) -> dict:
    """One fact for each ``X <verb> Y`` line of a few verbs; enough to drive the pipeline without a model."""
    kinds = {"likes": "preference", "loves": "preference", "met": "event", "visited": "event", "knows": "relationship", "runs": "habit", "lives": "place"}
    facts = []
    for line in prompt.splitlines():
        text = line.split("]: ", 1)[-1]
        m = re.search(r"\b([A-Z]\w+) (likes|loves|met|visited|knows|runs|lives)\b([^.!?]*)", text)
        if m:
            facts.append({"kind": kinds[m[2]], "statement": f"{m[1]} {m[2]}{m[3]}".strip(), "subjects": [m[1]], "place": None, "happened_at": None, "confidence": 0.9})
    return {"facts": facts, "notes": "escalated" if escalated else ""}


def name_judge(mention: str, candidate: str) -> dict:
    """Same only if one name's words all stand in the other."""
    a, b = set(mention.lower().split()), set(candidate.lower().split())
    same = bool(a and b) and (a <= b or b <= a)
    return {"same": same, "confidence": 0.9 if same else 0.1, "reason": "shared words" if same else "different words"}


def plain_sentences(statements: list[str]) -> list[str]:
    return [f"{s.rstrip('.')}." for s in statements]


def split_question(question: str) -> list[str]:
    parts = [p.strip() for p in re.split(r"\band\b|\?", question) if p.strip()]
    return parts[:3] or [question]


def quote_facts(question: str, prompt: str) -> str:
    """Repeats the facts of the prompt with their citations."""
    cited = re.findall(r"\[fact:([^\]]+)\] (.+)", prompt)
    return " ".join(f"{s.rstrip('.')} [fact:{i}]." for i, s in cited) or "No facts are known."


def stub_tags(content: bytes) -> dict[str, float]:
    seed = zlib.crc32(content)
    return {label: ((seed >> k) & 255) / 255 for k, label in enumerate(TAG_LABELS)}


def stub_photo_facts(content: bytes) -> dict:
    return {"scene": f"scene {zlib.crc32(content) % 100}", "activity": None, "people_count": 0, "notable": []}


@dataclass(frozen=True)
class Models:
    """The seams with their defaults."""

    embedder: BagEmbedder = field(default_factory=BagEmbedder)
    extractor: Callable[[str, bool], dict] = rule_extractor
    judge: Callable[[str, str], dict] = name_judge
    renderer: Callable[[list[str]], list[str]] = plain_sentences
    planner: Callable[[str], list[str]] = split_question
    answerer: Callable[[str, str], str] = quote_facts
    tagger: Callable[[bytes], dict[str, float]] = stub_tags
    ocr: Callable[[bytes], list[str]] = lambda content: []
    faces: Callable[[bytes], list[dict]] = lambda content: []
    photo_model: Callable[[bytes], dict] = stub_photo_facts


def backend(role: str, key: str | None = None) -> str:
    """Which backend serves a role: the environment decides, else hosted with a key and offline without one. An
    unknown role or value is a ValueError, and so is a forced hosted backend without a key."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    chosen = os.environ.get(f"QUILLON_{role.upper()}_BACKEND")
    if chosen is None:
        return "hosted" if key else "offline"
    if chosen not in BACKENDS:
        raise ValueError(f"unknown backend {chosen}")
    if chosen == "hosted" and not key:
        raise ValueError("the hosted backend needs a key")
    return chosen
