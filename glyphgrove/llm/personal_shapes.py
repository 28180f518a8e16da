"""Candidates for personal information in one text: spans by outward form, with their surroundings.

Forms are wide on purpose; whether a candidate is personal information is decided over the whole corpus, see
:mod:`glyphgrove.llm.personal`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_CAP = r"[A-ZÀ-ÖØ-ÞĀ-Ž]"
_NAME = rf"{_CAP}[\w'’­\-]*\w"

# Fixed values ------------------------------------------------------------------------------------------------
#: Seeds: a few words for each kind that stand among the three tokens before it; kinds of streets and endings of mail
#: addresses. All other words, labels, kinds and endings are learned from the corpus.
PHONE_SEEDS = frozenset(("phone", "tel", "tél", "call", "llamen"))
ID_SEEDS = frozenset(("id", "passport", "passeport", "sozialversicherungsnummer", "dni", "fiscale"))
NONE_SEEDS = frozenset(("order", "invoice", "ticket", "isbn", "part", "model", "coupon", "batch"))
PERSON_SEEDS = frozenset(("mr", "mrs", "dr", "herr", "frau", "mme", "señora", "signed"))
STREET_SEEDS = frozenset(("street", "rue", "calle", "strasse", "weg"))
MAIL_SEEDS = ("com", "org")
#: Titles, which stand before a name and aren't part of it.
TITLES = r"mr|mrs|ms|miss|dr|prof|herr|herrn|frau|m|mme|mlle|monsieur|madame|sr|sra|señor|señora|don|doña|sir|mx"
#: Kinds of streets; before the name, after it, or as the end of a compound.
STREET_AFTER = r"street|st|road|rd|lane|ln|avenue|ave|court|ct|terrace|close|drive|dr|way|place|pl|square|sq|crescent|gardens|grove|hill|row|mews|walk|boulevard|blvd|parkway|alley|park|green|rise|view"
STREET_BEFORE_ES = r"calle|c/|paseo|plaza|avenida|avda\.?|camino|ronda|travesía|carretera|carrera|vía|glorieta|cuesta"
STREET_BEFORE_FR = r"rue|avenue|boulevard|bd|place|chemin|impasse|quai|allée|cours|square|route|passage|sentier|voie|faubourg"
STREET_COMPOUND = r"straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|chaussee|steig|pfad|stieg|markt"
#: Capitalised words after a French street's name that begin the next sentence.
STARTS = r"Le|La|Les|L['’]\w+|Un|Une|Des|Du|De|Il|Elle|Ils|Elles|On|Je|J['’]\w+|Nous|Vous|Ce|C['’]\w+|Cet|Cette|Ces|Mon|Ma|Mes|Son|Sa|Ses|Notre|Votre|Mais|Et|Pour|À|Après|D['’]\w+|Très|Adresse|The|This|It|We|My|If|After|For"
#: First words of German street names that have no kind of street.
STREET_PREPOSITION = r"am|an der|an den|im|in der|auf der|auf dem|zum|zur|unter den|hinter der|vor dem|beim"
PARTICLES = r"van|von|de|der|den|da|di|del|della|la|le|du|dos|das|ten|ter|zu|zum|bin|ibn|al|el|y"
# -------------------------------------------------------------------------------------------------------------

_AT = r"(?:@|＠|\s?[(\[{]\s?(?i:at)\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?i:dot)\s?[)\]}]\s?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![\w.+\-])[\w](?:[\w.+\-]*[\w])?"
_TOP = r"[A-Za-z]{2,}(?![\w\-])"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}(?:{_LABEL}{_DOT})+{_TOP}"
    rf"|{_LOCAL}\s(?i:at)\s(?:{_LABEL}(?:\s(?i:dot)\s))+{_TOP}"
)

_HOUSE = r"\d{1,4}(?:\s?[A-Za-z](?![\w]))?(?:\s?[-–]\s?\d{1,4}[A-Za-z]?)?"
ADDRESS = [
    # number, then a name of one to three words, then the kind of street
    re.compile(rf"(?<![\w./\-]){_HOUSE} (?:{_NAME} ){{1,3}}?(?P<s>(?i:{STREET_AFTER}))(?!\w)(?:(?<=St)\.(?= [a-z,])|)"),
    re.compile(rf"(?<![\w./\-]){_HOUSE}(?:\s(?i:bis|ter|quater))?,? (?P<s>(?i:{STREET_BEFORE_FR}))(?: (?i:de la|des|du|de|d['’]|de l['’]|de l))? ?['’]?{_NAME}(?: (?!(?:{STARTS})(?!\w)){_NAME}(?!\w| ?:))*"),
    re.compile(rf"(?<!\w)(?P<s>(?i:{STREET_BEFORE_ES}))(?: (?i:de la|de los|de las|del|de))? ?{_NAME}(?: {_NAME})?,? (?:(?i:n[º°o.]|núm\.?|número)\s?)?{_HOUSE}(?!\w)"),
    re.compile(rf"(?<!\w)(?:{_CAP}[\w\-]*[\w] )?(?P<s>(?i:straße|strasse|platz|allee|weg|gasse))(?<=[A-ZÄÖÜa-zß]) {_HOUSE}(?!\w)"),
    re.compile(rf"(?<!\w){_CAP}[\w\-]*?(?P<s>(?i:{STREET_COMPOUND})) ?{_HOUSE}(?!\w)"),
]
#: Addresses that need the corpus' contexts: capitalised words without a known kind of street, names in lower case,
#: names after a preposition. A form that begins with "open" never speaks for an address by itself.
ADDRESS_OPEN = [
    (re.compile(rf"(?<![\w./\-:]){_HOUSE} {_NAME} (?P<s>{_NAME})"), ""),
    (re.compile(rf"(?<![\w./\-:]){_HOUSE} (?:[a-zß-öø-ÿ]+ ){{1,2}}?(?P<s>{STREET_AFTER})(?!\w)"), "open "),
    (re.compile(rf"(?<!\w)(?P<s>(?i:{STREET_PREPOSITION})) (?:{_NAME} )?{_NAME} {_HOUSE}(?!\w)"), "open "),
]

PHONE = re.compile(
    r"(?<![\w+/.\-])(?:\+\d{1,3}[ .\-/]?|00\d{2}[ .\-/])?(?:\(\d{2,5}\)[ ]?|\d{1,5}[ .\-/])?\d{2,8}(?:[ .\-/]\d{2,6}){0,4}(?![\w])(?![.\-/]\d)"
    r"|(?<![\w+/.\-])\+?\d{9,14}(?![\w])(?![.\-/]\d)"
)
ID = re.compile(
    r"(?<![\w/.@+\-])(?:[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Za-z]|\d{8}[- ]?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4}|[A-Za-z]\d{2}[A-Za-z]\d{2}[A-Za-z]\d{2,4}|[A-Za-z]{1,3}\d{6,9}|\d{7,11}[A-Za-z]?|[A-Za-z]\d{7}[A-Za-z])(?!\w)(?![.\-/]\d)"
)

#: Any run of digits or of mixed letters and digits, in pieces that each have a digit.
RUN = re.compile(r"(?<![\w/.@+\-])\+?[A-Za-z]*\d[A-Za-z0-9]*(?:[ .\-/][A-Za-z]*\d[A-Za-z0-9]*)*(?!\w)(?![.\-/]\d)")
#: Letters and digits from which a run is a candidate: after a seed word, where it is no seed yet and its form never
#: speaks for a kind, and anywhere.
SHORT_LEAST, RUN_LEAST = 4, 6

_AT_WORD = re.compile(r"[(\[{]\s?at\s?[)\]}]|\sat\s\S+\sdot\s", re.IGNORECASE)
_DIGIT, _THREE_DIGITS = re.compile(r"\d"), re.compile(r"\d[^\d]*\d[^\d]*\d")

_INITIALS = rf"(?:{_CAP}\.[ -]?)+"
_PARTICLE = rf"(?:(?i:{PARTICLES}) ){{0,3}}"
PERSON = re.compile(
    rf"(?<![\w'’.\-@/&])(?=(?P<a>(?P<g>{_NAME}) (?:{_INITIALS} ?)?(?P<p>{_PARTICLE})(?P<n>{_NAME})))"
    rf"|(?<![\w'’.\-@/&])(?=(?P<b>(?P<i>{_INITIALS}) ?(?P<p2>{_PARTICLE})(?P<n2>{_NAME})))"
)
REVERSED = re.compile(rf"(?<![\w'’.\-@/&])(?=(?P<a>(?P<n>{_PARTICLE}{_NAME}), (?P<g>{_NAME}(?: {_CAP}\.)?|{_CAP}\.)))")

_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[^\w\s]")
_SPACE = re.compile(r"\s+")
_TITLE = re.compile(rf"(?:{TITLES})\.?", re.IGNORECASE)
_SIR = re.compile(rf"M\. ?(?={_CAP}\.)")
_STREET_NEXT = re.compile(rf"\s+(?:{STREET_AFTER})\b", re.IGNORECASE)


def is_title(text: str) -> bool:
    return bool(_TITLE.fullmatch(text.strip()))


class Candidate(NamedTuple):
    pool: str  # mail, number, address, name
    found: str
    seed: str | None  # a kind, "none", or null
    left: list[str]  # up to three tokens, nearest first; "^" at the text's start
    right: list[str]
    form: str  # shape of a number, kind of a street
    given: str
    family: str
    start: int


def _tokens(text: str) -> list[str]:
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(text.casefold())]


_STOPS = frozenset(".!?。।؟！|/<>")


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """Three tokens on each side, nearest first, within the sentence; a stop after a short word ends none."""
    before, after = _tokens(text[max(0, a - 48) : a])[::-1], _tokens(text[b : b + 48])
    left: list[str] = []
    for i, t in enumerate(before[:3]):
        if t in _STOPS and not (t == "." and i + 1 < len(before) and len(before[i + 1]) <= 3):
            break
        left.append(t)
    right: list[str] = []
    for t in after[:3]:
        if t in _STOPS:
            break
        right.append(t)
    return [*left, "^", "^", "^"][:3], [*right, "$", "$", "$"][:3]


def _sign(mail: str) -> str:
    """How an address writes its at sign."""
    return "@" if "@" in mail or "＠" in mail else "bracket" if mail[-1].isalnum() and any(c in mail for c in "([{") else "word"


def _seed(pool: str, found: str, left: list[str], form: str) -> str | None:
    """Kind of a candidate that is a seed, or null. A name has its seed word right before, with a stop at most between."""
    if pool == "mail":
        return "email" if form == "@" and found.casefold().endswith(MAIL_SEEDS) else None
    if pool == "address":
        return "address" if form in STREET_SEEDS else None
    if pool == "name":
        near = left[1] if left[0] == "." else left[0]
        return "person" if near in PERSON_SEEDS and form == "" else None
    if form.startswith("short "):
        return None
    digits, before = form.count("0"), set(left)
    if before & NONE_SEEDS:
        return "none"
    if before & ID_SEEDS and 5 <= digits <= 15:
        return "id_number"
    return "phone" if before & PHONE_SEEDS and 6 <= digits <= 15 else None


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", s))


_LOWER = re.compile(r"(?<![\w.@+\-'’])[a-zß-öø-ÿ]{2,}(?![\w@+\-]|\.\w)")


_UPPER = re.compile(rf"(?<![\w.@+\-'’]){_NAME}(?![\w@+\-]|\.\w)")


def word_uses(text: str) -> list[tuple[str, str]]:
    """Words as case-folded, each with ``lower`` where it is written in lower case, which names are not, else empty."""
    return [(w, "lower") for w in _LOWER.findall(text)] + [(w.casefold(), "") for w in _UPPER.findall(text)]


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text, in no special order; spans of different pools may overlap."""
    out: list[Candidate] = []
    taken = bytearray(len(text))

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\1" * (b - a)

    def free(a: int, b: int) -> bool:
        return 1 not in taken[a:b]

    def add(pool: str, a: int, b: int, seed: str | None = None, form: str = "", given: str = "", family: str = "") -> None:
        left, right = _around(text, a, b)
        seed = seed or _seed(pool, text[a:b], left, form)
        out.append(Candidate(pool, text[a:b], seed, left, right, form, given, family, a))

    if "@" in text or "＠" in text or _AT_WORD.search(text):
        for m in EMAIL.finditer(text):
            add("mail", *m.span(), form=_sign(m[0]))
            take(*m.span())
    has_digit = bool(_DIGIT.search(text))
    for rx in ADDRESS if has_digit else ():
        for m in rx.finditer(text):
            if free(*m.span()):
                add("address", *m.span(), form=m["s"].casefold())
                take(*m.span())
    for rx, kind in ADDRESS_OPEN if has_digit else ():
        for m in rx.finditer(text):
            if free(*m.span()):
                add("address", *m.span(), form=kind + m["s"].casefold())

    numbers: list[tuple[int, int]] = []
    short = set()
    if _THREE_DIGITS.search(text):
        spans = {m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15}
        spans |= {m.span() for m in ID.finditer(text)}
        numbers = [(a, b) for a, b in spans if free(a, b)]
        known = bytearray(len(text))
        for a, b in numbers:
            known[a:b] = b"\1" * (b - a)
        loose = [(*m.span(), 7) for m in PHONE.finditer(text)] + [(*m.span(), SHORT_LEAST) for m in RUN.finditer(text)]
        for a, b, least in loose:
            n = sum(c.isalnum() for c in text[a:b])
            if n < least or sum(c.isdigit() for c in text[a:b]) < 3 or 1 in known[a:b] or not free(a, b):
                continue
            if n < RUN_LEAST:
                if not (PHONE_SEEDS | ID_SEEDS) & set(_around(text, a, b)[0]):
                    continue
                short.add((a, b))
            numbers.append((a, b))
            known[a:b] = b"\1" * (b - a)
    reach = 0
    for a, b in sorted(numbers, key=lambda x: (x[0], -x[1])):
        if b > reach:  # not inside a longer one
            add("number", a, b, form=("short " if (a, b) in short else "") + _shape(text[a:b]))
        reach = max(reach, b)
    for a, b in numbers:
        take(a, b)
    covered = 0
    for rx in (PERSON, REVERSED):
        for m in rx.finditer(text):
            d = m.groupdict()
            whole = "a" if d.get("a") else "b"
            a, b = m.span(whole)
            given, family = d.get("g") or d.get("i"), d.get("n") or d.get("n2")
            if whole == "b" and (title := _SIR.match(given)):  # an abbreviated title before initials
                a, given = a + title.end(), given[title.end() :]
            if _TITLE.fullmatch(given.rstrip(".")) and rx is PERSON or not free(a, b):
                continue
            if whole == "b" and b <= covered:  # the initials and family name of a full name
                continue
            if rx is PERSON and whole == "a" and (d["p"] or text[a:b].count(" ") > 1):
                covered = b
            after = text[b : b + 14]
            if re.match(r"\s+\d", after) or _STREET_NEXT.match(after) or re.match(r"\s*&", after):
                seed = "none"
            else:
                seed = None
            add("name", a, b, seed, form="caps" if text[a:b].isupper() else "reversed" if rx is REVERSED else "", given=given.casefold().strip(), family=family.casefold())
    return out
