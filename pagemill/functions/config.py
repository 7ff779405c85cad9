"""A site's configuration, read on the driver: what agents and search may see."""

from __future__ import annotations

from .routes import DEFAULT_BRANCH_MIN_PAGES

#: The keys of the ``agents`` block.
AGENTS_KEYS = ("index", "markdown", "exclude", "branchIndexes", "branchMinPages", "expectedOrigins")
SEARCHED = ("pages", "sections", "headings", "paragraphs", "links", "lists")


def _prefixes(value) -> list[str]:
    rows = value if isinstance(value, list) else [value]
    return ["/" + r.strip().strip("/") for r in rows if isinstance(r, str) and r.strip()]


def agents_config(config: dict | None) -> dict:
    """The ``agents`` block with its defaults: on, unless it says false."""
    agents = (config or {}).get("agents")
    on = agents is not False
    given = agents if isinstance(agents, dict) else {}
    least = given.get("branchMinPages")
    return {
        "index": on and given.get("index") is not False, "markdown": on and given.get("markdown") is not False, "exclude": _prefixes(given.get("exclude")),
        "branchIndexes": on and given.get("branchIndexes") is not False,
        "branchMinPages": least if isinstance(least, int) and not isinstance(least, bool) else DEFAULT_BRANCH_MIN_PAGES,
        "expectedOrigins": given.get("expectedOrigins"),
    }


def unknown_agents_keys(config: dict | None) -> list[str]:
    agents = (config or {}).get("agents")
    return [k for k in agents if k not in AGENTS_KEYS] if isinstance(agents, dict) else []


def search_config(config: dict | None) -> dict:
    """The ``search`` block with its defaults."""
    given = (config or {}).get("search") or {}
    include, exclude = given.get("include") or {}, given.get("exclude") or {}
    return {
        "enabled": given.get("enabled") is not False, "include": {k: include.get(k) is not False for k in SEARCHED},
        "exclude": {"routes": exclude.get("routes") or [], "components": exclude.get("components") or []},
    }
