"""Fixed values of the domain: vocabularies, patterns and formats that results depend on.

Everything here is data. Patterns are for normalised text (lower case, no accents,
single spaces) unless their comment says otherwise.
"""

# --- Fixed values: vocabularies -------------------------------------------------

STRONG_IT_TERMS = (
    "tecnico auxiliar de informatica",
    "tecnico informatico",
    "tecnico especialista en informatica",
    "tecnico especialista informatica",
    "tecnica informatica",
    "auxiliar de informatica",
    "auxiliar informatico",
    "ayudante de informatica",
    "ayudantes tecnicos informatica",
    "programador informatico",
    "programador",
    "operador informatico",
    "operador de sistemas",
    "tecnico de sistemas",
    "tecnico de sistemas informaticos",
    "soporte informatico",
    "soporte tic",
    "tecnico tic",
    "tecnologias de la informacion",
    "microinformatica",
    "administrador de sistemas",
    "administracion de sistemas informaticos",
    "desarrollo de aplicaciones",
    "desarrollo software",
    "c1 informatica",
    "c2 informatica",
    "c1 2003",
)

EMPLOYMENT_TERMS = (
    "convocatoria",
    "proceso selectivo",
    "oposicion",
    "concurso oposicion",
    "bolsa de empleo",
    "bolsa de trabajo",
    "personal laboral",
    "funcionario interino",
    "plaza",
    "lista de admitidos",
    "fecha de examen",
    "destinos",
    "nombramiento",
)

ACCEPTED_QUALIFICATIONS = (
    "bachiller",
    "tecnico superior",
    "fp de grado superior",
    "formacion profesional de grado superior",
    "ciclo formativo de grado superior",
    "desarrollo de aplicaciones multiplataforma",
    "desarrollo de aplicaciones web",
    "administracion de sistemas informaticos en red",
    "administracion de sistemas informaticos",
    "familia profesional informatica y comunicaciones",
    "educacion secundaria obligatoria",
    "graduado en eso",
    "titulo de tecnico",
)

UNIVERSITY_TERMS = (
    "grado en ingenieria informatica",
    "ingenieria informatica",
    "ingenieria tecnica informatica",
    "titulacion universitaria",
    "licenciatura",
    "diplomatura",
    "titulo universitario",
)

OWNER_MARKERS = ("junta de andalucia", "administracion general de la junta", "consejeria", "servicio andaluz de salud", "instituto andaluz", "agencia digital de andalucia")
ADMIN_ROLES = ("administrativo", "gestion administrativa", "gestion de funcion administrativa")
ADMIN_EXCEPTIONS = ("opcion informatica", "especialidad informatica", "sistemas informaticos")
WEAK_IT_TERMS = ("informatica", "sistemas informaticos", "tic", "aplicaciones")
MANDATORY_MARKERS = ("requisito", "se requiere", "estar en posesion", "deben estar en posesion", "deberan estar en posesion", "se exige", "debera poseer", "titulacion requerida", "como minimo")
ALTERNATIVE_MARKERS = (" o ", "alternativamente", "equivalente", "cualquiera de")
MERIT_MARKERS = ("merito", "se valorara", "valoracion", "baremo", "temario", "curso de")
OPEN_ACCESS = ("acceso libre", "turno libre", "plazas libres", "ingreso libre", "oposicion libre", "libre concurrencia", "abierta a cualquier aspirante", "abierto a cualquier aspirante")
INTERNAL_ACCESS = "promocion interna"
NEGATED_INTERNAL = (
    "no es de promocion interna",
    "no son de promocion interna",
    "no sera de promocion interna",
    "no seran de promocion interna",
    "sin promocion interna",
    "se excluyen las plazas reservadas a promocion interna",
    "se excluye la plaza reservada a promocion interna",
)
IT_FAMILY_TERMS = (
    "desarrollo de aplicaciones multiplataforma",
    "desarrollo de aplicaciones web",
    "administracion de sistemas informaticos en red",
    "administracion de sistemas informaticos",
    "desarrollo de aplicaciones informaticas",
    "familia profesional informatica",
    "familia profesional de informatica",
    "familia de informatica",
    "rama informatica",
)

#: Status by the first group of phrases that occurs.
STATUS_RULES = (
    (("anulacion", "anulada", "dejar sin efecto"), "ANULADA"),
    (("suspension", "suspendido", "suspendida"), "SUSPENDIDA"),
    (("reapertura", "nuevo plazo"), "REABIERTA"),
    (("propuesta de nombramiento",), "PROPUESTA_NOMBRAMIENTO"),
    (("eleccion de destinos", "destinos adjudicados"), "DESTINOS"),
    (("calificaciones", "relacion de aprobados", "listado provisional de personas aprobadas", "autobaremo", "convocatoria plazas adicionales", "notas definitivas", "notas segundo examen", "notas del segundo", "notas primer examen"), "NOTAS"),
    (("fecha de examen", "lugar de examen", "examen tendra lugar", "ejercicio se celebrara", "fecha del ejercicio"), "EXAMEN_ANUNCIADO"),
    (("lista definitiva de admitidos", "admitidos definitivos"), "ADMITIDOS_DEFINITIVO"),
    (("lista provisional de admitidos", "admitidos provisionales"), "ADMITIDOS_PROVISIONAL"),
    (("plazo de presentacion", "plazo de solicitudes"), "PLAZO_ABIERTO"),
    (("convoca proceso selectivo", "convocatoria"), "CONVOCADA"),
)
STATUS_OTHERWISE = "DETECTADA"
#: Ranks of ordinary statuses; one that isn't here counts as 0.
STATUS_RANK = {"DESCONOCIDA": 0, "DETECTADA": 1, "CONVOCADA": 2, "PLAZO_ABIERTO": 3, "PLAZO_CERRADO": 4, "ADMITIDOS_PROVISIONAL": 5, "ADMITIDOS_DEFINITIVO": 6, "EXAMEN_ANUNCIADO": 7, "EXAMEN_REALIZADO": 8, "NOTAS": 9, "DESTINOS": 10, "FINALIZADA": 11}
EXCEPTIONAL_STATUSES = ("ANULADA", "SUSPENDIDA", "REABIERTA")
LEAVING_STATUSES = ("REABIERTA", "PLAZO_ABIERTO")
APPLICABLE_STATUSES = ("PLAZO_ABIERTO", "REABIERTA", "CONVOCADA", "DETECTADA")
ADVANCED_STATUSES = ("NOTAS", "EXAMEN_ANUNCIADO", "EXAMEN_REALIZADO", "ADMITIDOS_PROVISIONAL", "ADMITIDOS_DEFINITIVO", "DESTINOS", "PROPUESTA_NOMBRAMIENTO", "FINALIZADA", "ANULADA", "SUSPENDIDA")
NO_REMINDER_STATUSES = ("PLAZO_CERRADO", "ANULADA", "FINALIZADA", "SUSPENDIDA")

COMPATIBLE, REVIEW, NOT_COMPATIBLE = "COMPATIBLE", "REVISAR", "NO_COMPATIBLE"
OPEN, INTERNAL_ONLY, MIXED, UNKNOWN_ACCESS = "LIBRE", "PROMOCION_INTERNA_EXCLUSIVA", "MIXTO", "REVISAR"

NUMBER_WORDS = {"una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5}
DAY_WORDS = {"cinco": 5, "diez": 10, "quince": 15, "veinte": 20, "treinta": 30, "cuarenta": 40, "sesenta": 60}
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
OWN_BULLETIN = {"boe": "BOE", "boja": "BOJA", "bop_jaen": "BOP"}
CHANGE_LABELS = {
    "positions": "numero de plazas",
    "access": "via de acceso",
    "qualification": "titulacion",
    "compatibility": "compatibilidad con FP",
    "deadline": "fecha limite",
    "deadline_confirmed": "confirmacion del plazo",
    "status": "estado del proceso",
    "exam_date": "fecha de examen",
    "exam_date_provisional": "carácter provisional del examen",
    "exam_time": "hora de examen",
    "exam_place": "lugar de examen",
    "group": "grupo",
    "locality": "localidad",
    "province": "provincia",
    "priority": "prioridad",
}
DETAIL_FIELDS = ("deadline", "deadline_confirmed", "exam_date", "exam_time", "exam_place", "status", "positions", "access", "compatibility", "group", "qualification", "exam_date_provisional")

# --- Fixed values: patterns ------------------------------------------------------

GENERIC_TITLE_WORDS = r"\b(resolucion|orden|anuncio|decreto|publica|publicacion|por la que|se convoca|convocatoria|correccion|errores?|lista|provisional|definitiva|fecha|examen|admitidos?|excluidos?|bases?)\b"
TITLE_YEARS = r"\b(?:19|20)\d{2}\b"
TITLE_NUMBERS = r"\b\d{1,5}\b"
YEAR = r"\b(20\d{2})\b"
IT_SIGNAL = (
    r"(?:\binformatic(?:a|as|o|os)\b|\bmicroinformatic(?:a|as|o|os)\b|\bprogramador(?:a|as|es)?\b|\bdesarrollador(?:a|as|es)?\b|\badministrador(?:a|as|es)?\s+de\s+sistemas\b"
    r"|\btecnic(?:a|as|o|os)\s+de\s+sistemas\b|\bsistemas?\s+informatic(?:o|os|a|as)\b|\bsistemas?\s+y\s+bases?\s+de\s+datos\b|\btecnologias?\s+de\s+la\s+informacion\b"
    r"|\bsoporte\s+tic\b|\btic\b|\bciberseguridad\b|\bsoftware\b|\bc1\s*2003\b)"
)
JOB_SIGNAL = (
    r"(?:\bconvoc|\boposici|\bprocesos?\s+selectivos?\b|\bbolsas?\b|\bplazas?\b|\badmitid|\bexcluid|\bexamen|\bejercicios?\b|\bbases\b|\btribunal|\bnombramiento"
    r"|\bbarem|\bresultados?\b|\blistad[oa]s?\b|\blistas?\b|\boferta\s+de\s+empleo\b)"
)
TAI = r"\bcuerpo de tecnicos auxiliares de informatica\b|\btai\b"
ROLE_WORDS = r"tecnic[oa]s?|auxiliar(?:es)?|ayudantes?|operador(?:a|es|as)?|programador(?:a|es|as)?|analistas?|administrador(?:a|es|as)?|soporte|desarrollador(?:a|es|as)?|especialistas?|opcion|especialidad"
IT_WORDS = r"informatic[oa]s?|sistemas|tic|software|aplicaciones|programador(?:a|es|as)?|microinformatica|redes|ciberseguridad|tecnologias de la informacion"
CORPS_IT = r"\b(?:a1|a2|b1|c1|c2)\s?\d{4}\b.*\b(?:informatic[oa]s?|tecnologias de la informacion|tic)\b"
ANALYST = r"\banalistas? programador"
IT_DEGREES = r"\b(?:dam|daw|asir)\b"
GROUP = r"\b(?:subgrupo|grupo)\s*(a1|a2|b|c1|c2|e)\b"
CORPS = r"\b(a1|a2|b1|c1|c2)\s?\d{4}\b"
POSITIONS = (r"\b(\d{1,5})\s+plazas?\b", r"\bplazas?\s*[:.-]?\s*(\d{1,5})\b", r"\b(una|dos|tres|cuatro|cinco)\s+plazas?\b")
PROVISIONAL_CUES = r"\b(?:provisional(?:mente)?|previst[oa]|aproximad[oa]|orientativ[oa]|pendiente de confirmar|se comunicara|a determinar)\b"
# On cleaned text with its accents, without regard to case:
QUALIFICATION_CUES = r"requisitos?\s+(?:de\s+)?titulaci[oó]n|titulaci[oó]n\s+requerida|estar en posesi[oó]n|se requiere|deber[aá] poseer"
ACT_DATES = r"resoluci[oó]n|decreto|\borden\b|acuerdo|boletin|bolet[ií]n|\bb\.?o\.?[epj]\b|\bboja\b|publicad[oa]s?|selectiv[oa]s|de fecha|firmad"
DEADLINE_RANGE = r"(?:plazo de presentaci[oó]n|solicitudes?)[^.\n]{0,100}?(?:del|desde)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})\s*(?:al|hasta(?:\s+el)?)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)"
DEADLINES = (
    r"(?:fin(?:al)?\s+de(?:l)?\s+plazo|hasta el|plazo de presentaci[oó]n)[^.\n]{0,120}?(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)",
    r"solicitudes?[^.\n]{0,100}?(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)",
)
RELATIVE_DEADLINE = r"plazo[^.]{0,120}?\b(\d{1,2}|cinco|diez|quince|veinte|treinta|cuarenta|sesenta)\s+d[ií]as\s+(h[aá]biles|naturales)([^.]{0,220})"
EXAM_DATES = (
    r"(?:fecha|celebraci[oó]n)[^.\n]{0,80}?(?:examen|ejercicio|prueba)[^.\n]{0,100}?(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)",
    r"(?:examen|ejercicio|prueba)[^.\n]{0,100}?(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)",
)
EXAM = r"examen|ejercicio|prueba"
EXAM_TIMES = (r"(?:a\s+las|hora(?:\s+de\s+inicio)?\s*[:.-]?)\s*([01]?\d|2[0-3])[:.]([0-5]\d)", r"\b([01]?\d|2[0-3])[:.]([0-5]\d)\s*h?\b")
EXAM_PLACES = (
    r"(?:lugar|sede)(?:\s+de\s+celebraci[oó]n)?\s*[:.-]\s*(.{2,120}?)(?=\s+(?:a\s+las\s+)?\d{1,2}[:.]\d{2}|[.;]|$)",
    r"\b(aula\s+[\w-]+(?:\s+[\w-]+){0,5}?)(?=\s+(?:a\s+las\s+)?\d{1,2}[:.]\d{2}|[.;]|$)",
)
REFERENCES = (r"\bBOE-[AB]-\d{4}-\d+\b", r"\bBOP[- ](?:\d{4})[- ]\d+\b")
SECRETS = (
    (r"\b\d{6,12}:[A-Za-z0-9_-]{30,}\b", "<redacted>"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1<redacted>"),
    (r"(?i)(authorization['\"]?\s*[:=]\s*['\"]?)[^'\"\s,}]{8,}", "$1<redacted>"),
    (r"/bot[^/\s]{20,}/", "<redacted>"),
)
FOLDER_PATH = r"^/download/(\d+)/([^/]+)/"
#: Wordings of a notice that changes a process whatever its fields say, with what they stand for.
NOTICE_CHANGES = (
    (("correccion de errores", "rectificacion"), "correccion o rectificacion oficial"),
    (("modificacion de las bases", "se modifican las bases", "modifica la convocatoria", "ampliacion de plazo"), "modificacion oficial pendiente de revision"),
)
