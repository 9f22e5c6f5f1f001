"""Profiles: one cited sentence per fact, in sections, kept as versions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from quillon.functions.scalars import extract_section
from quillon.operators.facts import SECTIONS, as_of, by_section, list_facts
from quillon.operators.store import Store

#: Facts that a profile is made of.
MOST_FACTS = 100_000


def render(sections: dict[str, list[tuple[str, str]]], renderer: Callable[[list[str]], list[str]]) -> str:
    """Markdown of (fact id, statement) lists; a missing or blank sentence falls back to the statement. The
    citations are added here, never by a model."""
    blocks = []
    for title, _ in SECTIONS:
        facts = sections.get(title)
        if not facts:
            continue
        statements = [s for _, s in facts]
        try:
            sentences = list(renderer(statements))
        except Exception:  # a renderer may fail in any way; the statements stand for it
            sentences = []
        lines = []
        for k, (fact, statement) in enumerate(facts):
            text = sentences[k] if k < len(sentences) and sentences[k] and sentences[k].strip() else statement
            lines.append(f"{text.strip().rstrip('.')} [fact:{fact[:8]}].")
        blocks.append(f"## {title}\n" + "\n".join(lines))
    return "\n\n".join(blocks)


def synthesize(store: Store, renderer: Callable[[list[str]], list[str]], now: datetime, compare: str = "count") -> bool:
    """Save a new version unless the latest one counts as many facts as are valid now; ``compare='content'`` asks
    whether the text would differ instead. True if a version was saved."""
    valid = as_of(store.read("facts"), now)
    n = min(valid.count(), MOST_FACTS)
    last = store.latest_profile().collect()
    if compare == "count" and last and last[0]["fact_count"] == n:
        return False
    placed = by_section(list_facts(store.read("facts"), None, MOST_FACTS, now)).orderBy("section_no", "section_rank").select("section", "id", "statement")
    sections: dict[str, list[tuple[str, str]]] = {}
    for r in placed.collect():  # at most MOST_FACTS rows
        sections.setdefault(r["section"], []).append((r["id"], r["statement"]))
    body = render(sections, renderer)
    if compare == "content" and last and last[0]["body"] == body:
        return False
    store.save_profile(body, n, now)
    return True


def section(store: Store, name: str | None = None) -> str:
    """The latest profile or one section of it, or a sentence that there is none."""
    last = store.latest_profile()
    if name is None:
        row = last.select("body").head(1)
        return row[0][0] if row else "There is no profile yet."
    row = last.select(extract_section(F.col("body"), F.lit(name))).head(1)
    return "There is no profile yet." if not row else row[0][0] or f"The profile has no section {name}."
