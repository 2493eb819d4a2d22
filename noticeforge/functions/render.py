"""Messages from events, within a budget of characters."""

from __future__ import annotations

import html
import json
import re

#: Characters of a message, changes and links in it. Fixed values.
MOST_CHARS, MOST_CHANGES, MOST_LINKS = 4096, 6, 5
HEADINGS = {"NEW": "Nueva convocatoria", "REVIEW": "Convocatoria por revisar", "UPDATE": "Cambios en un proceso", "REMINDER": "Recordatorio de plazo", "CARD": "Ficha del proceso"}


def escaped(value: object, budget: int) -> str:
    """HTML-escaped text of at most budget characters; entities stay whole, a cut text ends in an ellipsis."""
    whole = html.escape("" if value is None else str(value))
    if len(whole) <= budget:
        return whole
    out, size = [], 0
    for ch in str(value):
        e = html.escape(ch)
        if size + len(e) > budget - 1:
            break
        out.append(e)
        size += len(e)
    return "".join(out) + "…"


def value_text(v: object) -> str:
    if isinstance(v, bool) or v in ("true", "false"):
        return "sí" if v in (True, "true") else "no"
    parts = str(v or "").split("-")
    return f"{parts[2]}/{parts[1]}/{parts[0]}" if len(parts) == 3 and all(p.isdigit() for p in parts) and len(parts[0]) == 4 else str(v if v is not None else "sin dato")


def message(kind: str, payload: str) -> str:
    """The message of an event whose payload has process fields, changes and links."""
    p = json.loads(payload)
    lines = [f"<b>{HEADINGS.get(kind, 'Aviso')}</b>", f"<b>{escaped(p.get('title'), 500)}</b>", escaped(p.get("organisation"), 200)]
    for label, field in (("Estado", "status"), ("Plazas", "positions"), ("Plazo", "deadline"), ("Examen", "exam_date"), ("Lugar", "exam_place")):
        if p.get(field) not in (None, ""):
            lines.append(f"{label}: {escaped(value_text(p[field]), 200)}")
    for c in (p.get("change_details") or [])[:MOST_CHANGES]:
        lines.append(f"• {escaped(c['label'], 80)}: {escaped(value_text(c.get('old')), 120)} → {escaped(value_text(c.get('new')), 120)}")
    links = [x for x in p.get("links") or [] if str(x.get("url", "")).lower().startswith(("http://", "https://"))]
    for x in links[:MOST_LINKS]:
        lines.append(f'<a href="{escaped(x["url"], 500)}">{escaped(x.get("label") or "Enlace", 80)}</a>')
    out = ""
    for line in lines:
        if len(out) + len(line) + 1 > MOST_CHARS:
            break
        out += ("\n" if out else "") + line
    return out


#: Ids that buttons may carry, as a pattern, and the buttons' texts. Fixed values.
BUTTON_ID = r"[0-9a-f]{32}|[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}"
DETAILS, FOLLOW, OFFICIAL, COPY = "🔎 Ver detalles", "⭐ Seguir", "🔗 Fuente oficial", "📋 Copiar comando"


def keyboard(payload: str) -> dict | None:
    """Buttons of an event's message; None where the payload has no whole id of an entity."""
    p = json.loads(payload)
    own = str(p.get("process_id") or "")
    if not re.fullmatch(BUTTON_ID, own):
        return None
    url = next((x["url"] for x in p.get("links") or [] if str(x.get("url", "")).lower().startswith(("http://", "https://"))), "")
    rows = [{"text": DETAILS, "callback_data": f"d:{own}:a:1"}, {"text": FOLLOW, "callback_data": f"f:{own}:a:1"}]
    rows += [{"text": OFFICIAL, "url": url}] if url else []
    return {"inline_keyboard": [[r] for r in (*rows, {"text": COPY, "copy_text": {"text": f"/detalle {own}"}})]}
