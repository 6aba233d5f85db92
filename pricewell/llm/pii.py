"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, place_names, text_slices

#: The kinds in their order. The first four are the base: their spans stay whatever the score.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "national_id", "secret")
#: Of the added kinds those that stand even where they overlap a base span: their shape alone says much.
STRONG = ("iban", "secret")
KINDS = BASE + ADDED

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A run of digits can only match from its start, so the other starts in it are not tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
#: Characters of an IBAN by country, from the public ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN_RESTS = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
#: Long runs of letters, digits and the marks of base64; which of them may be secrets is for looks_secret() to say.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
#: Beginnings by which some services mark their keys.
KEY_MARKS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a proposed span before its context is read, and words that raise it when they stand within REACH characters.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "national_id": 0.3, "secret": 0.3}
#: Whole words, in English, German, French and Spanish.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "kontakt", "courriel", "contacter", "correo", "contacto"),
    "ip": ("ip", "address", "host", "server", "adresse", "rechner", "hôte", "serveur", "dirección", "servidor"),
    "card": ("card", "visa", "credit", "pay", "karte", "kreditkarte", "zahlung", "carte", "paiement", "crédit", "tarjeta", "pago", "crédito"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "anruf", "handy", "téléphone", "appeler", "portable", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "virement", "cuenta", "banco", "transferencia"),
    "national_id": ("ssn", "social security", "tax id", "national id", "sozialversicherung", "steuernummer", "ausweis", "sécurité sociale", "numéro fiscal", "seguridad social", "dni"),
    "secret": ("token", "secret", "key", "api key", "apikey", "api_key", "password", "passwd", "bearer", "credential", "credentials", "passwort", "kennwort", "schlüssel", "geheimnis", "mot de passe", "clé", "jeton", "contraseña", "clave", "secreto"),
}
CONTEXT["local_phone"] = (*CONTEXT["phone"], "dial", "wählen", "composer", "marcar")
NEAR = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, words))})(?![^\W_])") for kind, words in CONTEXT.items()}
REACH, RAISE, LEAST = 40, 0.3, 0.5
#: Score of a secret that starts with one of KEY_MARKS.
MARKED = 0.7


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str):
    """As many characters as the country's IBANs have, single spaces between them left out, that pass mod 97."""
    for m in IBAN.finditer(text):
        rest = IBAN_RESTS.get(IBAN_LENGTHS.get(m[1]))
        if rest and (r := rest.match(text, m.end())) and mod97(text[m.start() : r.end()]):
            yield m.start(), r.end()


def looks_secret(s: str) -> bool:
    """Letters and digits mixed, in hexadecimal of 32 digits and more, or in both cases; no path or long word."""
    digits, lower, upper = any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)
    if not digits or not (lower or upper):
        return False
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return len(s) >= 32
    return lower and upper and s.count("/") <= 2 and s.count("-") <= 2


def _emails(text: str):
    """Around each @, which is rare: the longest local part before it, the longest domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL_PART))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _plain_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def proposals(text: str):
    """(kind, start, end) of the spans whose pattern and validator agree, by kind and start."""
    for start, end in _emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() > 12 and 13 <= len(d := _plain_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_plain_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in NATIONAL_ID.finditer(text):
        yield "national_id", m.start(), m.end()
    for m in OPAQUE.finditer(text):
        if looks_secret(m[0]) or m[0].startswith(KEY_MARKS):
            yield "secret", m.start(), m.end()


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind and start. Added kinds need a score of LEAST, and those that aren't
    STRONG overlap no base span. Context is a whole word within REACH characters before or after."""
    out, base = [], []
    for kind, start, end in proposals(text or ""):
        near = (text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]).lower()
        prior = MARKED if kind == "secret" and text.startswith(KEY_MARKS, start) else PRIOR[kind]
        score = min(1.0, prior + RAISE * bool(NEAR[kind].search(near)))
        if kind in BASE:
            base.append((start, end))
        elif score < LEAST or kind not in STRONG and any(s < end and start < e for s, e in base):
            continue
        out.append((kind, start, end, score))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans (kind, start, end in code points, end exclusive, score), by kind and start.

    Null and empty texts have no spans. Ids may be null or repeat. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches, 1):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(x)] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, _ARROW)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, spans {SPANS}")


def span_text(spans, kinds=KINDS):
    """kind:start:end of the spans of these kinds, comma-joined in their order, as a column."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union takes the first's kind."""
    if text is None:
        return None
    out, end = [], 0
    for kind, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col masked; every row and column stays, null texts stay null. Columns may have
    any names."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in text_slices(batches, at):
            new = pa.array([redact(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    plain = docs.toDF(*place_names(docs.columns))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)
