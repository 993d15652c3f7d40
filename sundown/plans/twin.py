"""Assembles the SQL twin of a query from named common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """Register a derived view under a name the twins may select from."""
    VIEWS[name] = body.strip()


def twin(body: str, **steps: str) -> str:
    """``body`` preceded by its own ``steps`` and every registered view they mention."""
    known = {**VIEWS, **steps}
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in known:
            if name in ordered or name in path:
                continue
            if re.search(rf"\b{re.escape(name)}\b", text):
                visit(known[name], (*path, name))
                if name not in ordered:
                    ordered.append(name)

    visit(body, ())
    if not ordered:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{known[n]}\n)" for n in ordered) + "\n" + body.strip()
