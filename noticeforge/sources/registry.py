"""Which sources a run asks: a configuration's enabled ones, each with the reader of its kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping

#: Kinds of sources. A fixed value.
KINDS = ("boe_api", "boja_api", "pag", "bop_jaen", "diputacion_jaen_api", "ayuntamiento_jaen", "html")


def chosen(config: Mapping, readers: Mapping[str, Callable], selected: set[str] | None = None) -> list[tuple[str, Callable, dict]]:
    """name, reader and settings of the enabled sources, of the selected ones if some are; an unknown kind is an error."""
    out = []
    for name, own in (config.get("sources") or {}).items():
        if not own.get("enabled", True) or (selected and name not in selected):
            continue
        kind = own.get("kind", "html")
        if kind not in KINDS or kind not in readers:
            raise ValueError(f"source {name}: no reader of kind {kind!r}")
        out.append((name, readers[kind], dict(own)))
    return out


def setting(config: Mapping, path: str, otherwise=None):
    """A nested setting by its dotted path."""
    at = config
    for key in path.split("."):
        if not isinstance(at, Mapping) or key not in at:
            return otherwise
        at = at[key]
    return at


def fallback(routes: list[tuple[str, Callable[[], list | None]]]) -> tuple[str, list, str]:
    """The first route's name and rows that work, and the errors of those before it. A route that returns None says that the day is empty; if all fail, the last error is raised."""
    errors = []
    for i, (name, route) in enumerate(routes):
        try:
            return name, route() or [], "; ".join(errors)
        except Exception as e:
            if i == len(routes) - 1:
                raise
            errors.append(f"{name}: {e}")
    return "", [], ""


def isolated(sources: list[tuple[str, Callable, dict]], ask: Callable) -> tuple[list, dict[str, dict]]:
    """Rows of all sources that can be read, and by source what its reader says of its coverage; one that fails doesn't stop the others."""
    rows, reports = [], {}
    for name, reader, own in sources:
        try:
            found, reports[name] = ask(reader, name, own)
            rows += found
        except Exception as e:
            reports[name] = {"error": f"{type(e).__name__}: {e}"}
    return rows, reports
