"""The query mini-language: quotes, ``title:``, ``tag:``, ``-word`` and aliases."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass
class Query:
    text: str = ""
    title: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @property
    def recall(self) -> str:
        """What the routes look for: the free text and the words asked of the title."""
        return " ".join([self.text, *self.title]).strip()


def words(text: str) -> list[str]:
    """Split at white space outside double quotes; the quotes go."""
    found: list[str] = []
    for k, part in enumerate(text.strip().split('"')):
        pieces = [part] if k % 2 else part.replace("　", " ").split()
        glued = k and found and (k % 2 == 0 and part[:1].strip() or k % 2 and text.strip().split('"')[k - 1][-1:].strip())
        if glued and pieces:
            found[-1] += pieces.pop(0)
        found += pieces
    return [w for w in found if w]


def parse(text: str, aliases: dict[str, str] | None = None) -> Query:
    """Each alias is expanded once, its words at the end; so loops of aliases end."""
    out, free, used = Query(), [], set()
    todo = words(text)
    at = 0
    while at < len(todo):
        word, at = todo[at], at + 1
        if aliases and word in aliases and word not in used and word[0] != "-" and ":" not in word:
            used.add(word)
            todo += words(aliases[word])
            continue
        bare = word.strip("\"'")
        prefix, _, rest = bare.partition(":")
        if prefix in ("title", "tag") and word.startswith(f"{prefix}:"):
            if rest.strip("\"'"):
                (out.title if prefix == "title" else out.tags).append(rest.strip("\"'"))
        elif word[0] == "-" and len(word) > 1:
            out.exclude.append(word[1:].strip("\"'"))
        else:
            free.append(bare)
    out.text = " ".join(free)
    return out


def aliases_of(text: str | None) -> dict[str, str]:
    """Aliases from JSON text; bad JSON gives none."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        return {}
    return {str(k): v for k, v in given.items() if isinstance(v, str)} if isinstance(given, dict) else {}
