"""What a run reports: outcome, text within a budget, metrics and report files."""

from __future__ import annotations

import html
import json
from pathlib import Path

#: Characters of an escaped report. A fixed value.
MOST_CHARS = 3900
#: Headings by outcome. Fixed values.
FAILED = "❌ BÚSQUEDA FALLIDA"
NO_SOURCES = "❌ NINGUNA FUENTE CONSULTADA — NO SIGNIFICA «SIN NOVEDADES»"
INCOMPLETE = "⚠️ BÚSQUEDA TERMINADA CON COBERTURA INCOMPLETA"
WARNED = "⚠️ BÚSQUEDA COMPLETADA CON AVISOS DE COBERTURA"
UNDELIVERED = "⚠️ BÚSQUEDA TERMINADA CON AVISOS PENDIENTES"
NOTHING_NEW = "✅ BÚSQUEDA COMPLETADA SIN NOVEDADES"
DONE = "✅ BÚSQUEDA COMPLETADA"


def collection(summary: dict) -> dict:
    """The counters of a run's summary, over all its sources."""
    keys = ("fetched", "included", "created", "updated", "unchanged", "filtered", "compatible", "review", "not_compatible")
    own = {k: sum(s.get(k, 0) for s in summary["sources"].values()) for k in keys}
    return own | {k: summary.get(k, {}) for k in ("sources", "warnings", "errors")} | {"sources_attempted": len({*summary["sources"], *summary.get("warnings", {}), *summary.get("errors", {})})}


def outcome(found: dict | None) -> str:
    attempted = (found or {}).get("sources_attempted", 0)
    errors, warnings = (len((found or {}).get(k) or {}) for k in ("errors", "warnings"))
    return "MISSING" if not attempted else "NO_SOURCES" if errors >= attempted else "PARTIAL" if errors or warnings else "OK"


def heading(report: dict) -> str:
    found, delivery = report.get("collection"), report.get("delivery") or {}
    rules = (
        (report.get("status") != "success", FAILED),
        (outcome(found) == "NO_SOURCES", NO_SOURCES),
        (bool((found or {}).get("errors")), INCOMPLETE),
        (bool((found or {}).get("warnings")), WARNED),
        (bool(delivery.get("retryable") or delivery.get("uncertain")), UNDELIVERED),
        (found is not None and not found.get("created") and not found.get("updated"), NOTHING_NEW),
    )
    return next((text for holds, text in rules if holds), DONE)


def lines(report: dict) -> list[str]:
    """The report's lines, from counters."""
    out, found, delivery = [heading(report), "Automática" if report.get("event") == "schedule" else "Manual", ""], report.get("collection"), report.get("delivery")
    if found is None:
        out.append("No se completó la consulta de fuentes.")
    else:
        errors, warnings = found.get("errors") or {}, found.get("warnings") or {}
        out.append(f"Fuentes: {found.get('sources_attempted', 0) - len(errors) - len(warnings)} al día, {len(warnings)} con aviso, {len(errors)} fallidas.")
        out.append(f"Registros: {found.get('fetched', 0)}; procesos nuevos: {found.get('created', 0)}; actualizados: {found.get('updated', 0)}.")
        if "compatible" in found:
            out.append(f"Incluidos: {found['compatible']} compatibles, {found.get('review', 0)} por revisar, {found.get('not_compatible', 0)} que ya no cumplen el perfil.")
        for title, notes in (("Fuentes fallidas:", errors), ("Avisos de cobertura:", warnings)):
            out += [title, *(f"- {name}: {str(note)[:300]}" for name, note in sorted(notes.items()))] if notes else []
    if delivery is None:
        out.append("Entrega no registrada.")
    else:
        out.append(f"Avisos enviados: {delivery.get('sent', 0)}; por reintentar: {delivery.get('retryable', 0)}; inciertos: {delivery.get('uncertain', 0)}; descartados: {delivery.get('suppressed', 0)}.")
    failed = [name for name, state in (report.get("steps") or {}).items() if state == "failure"]
    return out + ([f"Pasos fallidos: {', '.join(failed)}"] if failed else [])


def render(report: dict) -> str:
    """The escaped report. Lines that don't fit go from the end, whole, so that no entity is cut; the url stays."""
    own, url = lines(report), str(report.get("url") or "")
    whole = html.escape("\n".join([*own, "", url]))
    end = html.escape(f"\n…\n{url}")
    while len(whole) > MOST_CHARS and len(own) > 1:
        own.pop()
        whole = html.escape("\n".join(own)) + end
    return whole[:MOST_CHARS]


def merge_metrics(path: str, values: dict) -> dict:
    """The file's top-level keys with values put over them, written back."""
    at = Path(path)
    out = (json.loads(at.read_text(encoding="utf-8")) if at.exists() else {}) | values
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(out, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return out


def write_report(path: str, report: dict) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def deliver(report: dict, send) -> None:
    """One message, never sent again: a lost answer must not repeat it."""
    try:
        send(render(report))
    except Exception:
        raise RuntimeError("the report's delivery is uncertain") from None
