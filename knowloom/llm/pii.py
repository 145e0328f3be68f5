"""Personal information inside free text.

Patterns propose spans, check digits and number ranges confirm or refute them, and words nearby raise or lower their score.
Spans above a threshold are mentions; :func:`redact` writes a placeholder of the type in place of each.

Names are found without any list of names: by their shape (title, initial, particle, two capitalised words), by what stands on
either side, by a mention of another kind next to them or an e-mail that spells them, and, as one weak score among these,
by whether a public tokenizer's vocabulary knows the word rather in lower case or rather with a capital.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.llm.tokens import VOCABULARY, vocabulary_ranks

#: Least score of a mention.
THRESHOLD = 2.5

# Function words of English, German and Spanish, which are no part of a name.
CLOSED = frozenset(
    (
        "a about after again all also always am an and any are as at be because before both but by can could did do does each else every for from had has have he her here him his how i if in is it its "
        "just let many may me might more most my never no nor not now of off on only or other our out over please she should since so some such than that the their them then there these they this those "
        "to too under until up us very was we were what when where which while who why will with would yes you your "
        "aber als auch auf aus bei bitte das dass dem den denn der des die diese dieser du ein eine einem einen einer er es für hat hier ich ihr im in ist ja jede jeder kein keine man mit nach nein nicht noch "
        "nur ob oder ohne sein seit sich sie sind um und uns unter vom von vor war wenn werden wie wir wird zu zum zur "
        "al ante cada como con cuando de del desde donde el ella en entre era es esa ese esta este están fue ha hay la las le lo los más me mi muy ni no nos o para pero por porque que se según ser si sin "
        "sobre son su sus también te tras tu un una unos y ya"
    ).split()
)
# Words that lead names of places, and of days and months.
PLACE_LEADS = frozenset(
    "new north south east west northern southern eastern western san santa los las saint st mount lake fort port united great grand central upper lower hong "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
)

_LEFT = r"(?<![\w@./#+-])"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Herr|Frau|Sr|Sra|Srta|Don|Doña|Señor|Señora)\.?"
_LETTER = r"[^\W\d_]"
_CAP = rf"[A-ZÀ-ÖØ-Þ]{_LETTER}+"
_PARTICLE = r"(?i:van|von|de|del|della|di|da|dos|der|den|la|las|los|le|ter|zu|zum|zur|af|al|el|bin|ibn)"
_SPACE = "[ \u00a0]"
_SURNAME = rf"(?:[OD]['’])?{_CAP}(?:['’-]{_CAP}){{0,3}}"

EMAIL = re.compile(r"(?<![\w.%+-])[^\W_][\w.%+'-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[A-Za-z]{2,}(?![\w-]|\.\w|:[\w~/])")
_DOT = r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.)"
#: Dots stand between the parts only, so that a row of them is read in one way.
HIDDEN_EMAIL = re.compile(rf"(?<![\w.%+-])[^\W_][\w%+'-]*(?:{_DOT}[\w%+'-]+){{0,8}}\s?[(\[{{]\s?at\s?[)\]}}]\s?[\w-]+(?:{_DOT}[\w-]+){{1,8}}", re.I)
SPELT_EMAIL = re.compile(r"(?<![\w.%+-])[^\W_][\w.%+'-]* at [\w-]+(?: dot [\w-]+){1,8}", re.I)

PHONE = re.compile(
    _LEFT + r"(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,4}"  # international
    r"|00[1-9]\d{0,2}[ ./-](?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,4}"
    r"|(?:1[ .-])?(?:\([2-9]\d\d\)[ ]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}"  # North America
    r"|(?:\(0[1-9]\d{0,4}\)[ /-]?|0[1-9]\d{0,4}[ /-])\d{2,8}(?:[ -]\d{2,5}){0,3}"  # trunk prefix
    r"|[6-9]\d\d(?: \d{2}){3}|[6-9]\d\d(?: \d{3}){2}"  # Spain
    r"|\d{7,12}"
    r")(?![\w@]|[-./:]\d| \d)"
)
_ANNOUNCED = (
    r"(?i:\b(?:ssn|social[ -]security(?: card)?|national[ -]insurance|ni(?= (?:number|no))|nino|dni|nif|nie|documento (?:nacional )?de identidad|cédula|"
    r"tax(?:payer)? id(?:entification)?|tax(?= (?:number|no))|tin|itin|steuer-?id(?:-?nr)?|steueridentnummer|steueridentifikationsnummer|steuernummer|"
    r"passport|pasaporte|reisepass(?:nummer)?|passnummer|passnr|driver['’]?s?['’]? licen[cs]e|driving licen[cs]e|licen[cs]e|führerschein(?:nummer)?|permiso de conducir|carnet de conducir|"
    r"personalausweis(?:nummer)?|ausweis(?:nummer)?|national id(?:entity)?|identity (?:card|number)|id card)"
    r"(?:\s?(?:id|card|number|no|nr|num|núm|nº|n\.º)\b\.?)?[\s:#=(]{0,4})"
)
ANNOUNCED_ID = re.compile(
    _ANNOUNCED + r"(\d{3}[- ]?\d\d[- ]?\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[XYZ]?-?\d{7,8}[- ]?[A-Z]|\d\d ?\d{3} ?\d{3} ?\d{3}|[A-Z]{1,5}\d{5,8}(?:[A-Z]{1,2}\d{0,3}[A-Z]{0,2})?|[A-Z0-9]*\d[A-Z0-9]*\d{3}[A-Z0-9]*)(?!\w)"
)
BARE_ID = re.compile(r"(?<![\w.#-])(?:(?P<ssn>\d{3}-\d\d-\d{4})|(?P<nino>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D])|(?P<dni>[XYZ]?\d{7,8}-?[A-HJ-NP-TV-Z]))(?![\w-])")

_SUFFIX = r"(?i:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|crescent|cres|boulevard|blvd|terrace|ter|place|pl|square|sq|close|parkway|pkwy|highway|hwy|row|walk|mews|way)"
_UNIT = r"(?i:flat|apt|apartment|unit|suite|ste|room|floor)\.? ?#?\d*[A-Za-z]?"
ADDRESS = re.compile(
    rf"(?<![\w./#-])(?:(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]?,? (?:(?:NE|NW|SE|SW|[NSEW])\.? |(?i:north|south|east|west) )?(?:[A-ZÀ-Þ][\w'’-]*\.? ){{1,3}}?{_SUFFIX}\b\.?(?:,? {_UNIT}\b)?"
    r"|(?i:p\. ?o\. ?box|po box|post office box|postfach|apartado(?: de correos)?|casilla) \d[\d ]*\d?"
    r"|(?:C/|(?i:calle|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|ronda|travesía|carrer)) ?(?:de (?:la |los |las |el )?|del )?[A-ZÀ-Þ][\w'’-]*(?: (?:de |del |la )*[A-ZÀ-Þ][\w'’-]*)*,? \d+[a-zA-Z]?(?:, ?\d+ ?º ?\w?\b)?"
    r"|[A-ZÀ-Þ][\w-]*(?:straße|strasse|str\.|STRASSE|STRAßE|STR\.|weg|WEG|gasse|GASSE|platz|PLATZ|allee|ALLEE) \d{1,4} ?[a-zA-Z]?\b(?:, \d{5} [A-ZÀ-Þ]\w+)?"
    r"|(?!(?:Der|Die|Das|Den|Dem|Des|Ein|Eine[mnrs]?|Kein|Keine[mnrs]?|Jede[mnrs]?|Diese[mnrs]?|Im|Vom|Beim|Auf|Ab)\b)[A-ZÀ-Þ][\w-]* (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Damm|Ufer|Chaussee|Ring|Markt) \d{1,4}(?: ?[a-z])?\b(?:, \d{5} [A-ZÀ-Þ]\w+)?"
    r"|(?:Am|Im|An de[mnr]|Auf de[mnr]|In de[nr]|Zum|Zur|Unter den|Hinter de[mr]|Vor de[mr]) (?:[A-ZÀ-Þ][\w-]* )?[A-ZÀ-Þ][\w-]* \d{1,4} ?[a-z]?, \d{5} [A-ZÀ-Þ]\w+"
    r"|[A-ZÀ-Þ][\w-]*(?:ring|damm|ufer|chaussee|gate|markt|hof) \d{1,4} ?[a-z]?, \d{5} [A-ZÀ-Þ]\w+)"
)

_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d\d(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\w])")
_CARD = re.compile(r"(?<![\w+.-])[2-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{1,7}|([ -]?)\d{6}\2\d{4,5})(?![\w-])")
_IBAN_CUE = re.compile(r"(?i:iban)[ :#]*$")
_PHONE_CUE = re.compile(r"(?i:phone|tel|call|mobile|cell|fax|ring|handy|rufnummer|teléfono|telefono|móvil|llam|number|reach|whatsapp|contact)[^\n]{0,24}$")
_NO_PHONE = re.compile(r"(?i:\b(?:build|timestamp|range|port|offset|issue|pr|commit|uuid|hash|line|version|release|code|id|shard|order|ticket|epoch|isbn|iban|card)[ #:=]*)$")

_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


class Mention(NamedTuple):
    pii_type: str
    start: int
    end: int
    score: float


# -- check digits --------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check digits of bank accounts in the international form."""
    moved = code[4:] + code[:4]
    return moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def dni_letter(code: str) -> bool:
    """The check letter of Spanish identity numbers."""
    number = code.replace("-", "").replace(" ", "")
    number = number[0].translate(str.maketrans("XYZ", "012")) + number[1:]
    return number[:-1].isdigit() and _DNI_LETTERS[int(number[:-1]) % 23] == number[-1]


def tax_digit(digits: str) -> bool:
    """The check digit of German tax identification numbers: eleven digits, no leading zero, ISO 7064 mod 11, 10."""
    if len(digits) != 11 or digits[0] == "0":
        return False
    product = 10
    for ch in digits[:-1]:
        total = (int(ch) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def ssn_range(digits: str) -> float:
    """1 for a number that may have been issued, -0.5 where the area is kept out of use, less where a group is all zeros."""
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    if area == "000" or serial == "0000":
        return -5.0
    return -2.0 if group == "00" else -0.5 if area == "666" or area >= "900" else 1.0


def _checked(code: str) -> float:
    """What check digits and ranges say of an identity number: above 0 confirmed, below 0 refuted, 0 where its form has none."""
    bare = re.sub(r"[ -]", "", code).upper()
    if re.fullmatch(r"\d{9}", bare):
        return ssn_range(bare)
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare) and (bare[0] in "XYZ") + len(bare) - 2 >= 7:
        return 1.5 if dni_letter(bare) else -1.5
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-Z]", bare):
        return 1.0 if bare[0] not in "DFIQUV" and bare[1] not in "DFIOQUV" and bare[:2] not in ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ") and bare[-1] in "ABCD" else -0.5
    if re.fullmatch(r"\d{11}", bare):
        return 1.0 if tax_digit(bare) else -0.5
    return 0.0


# -- spans ---------------------------------------------------------------------


def _emails(text: str) -> Iterator[Mention]:
    for pattern, score in ((EMAIL, 5.0), (HIDDEN_EMAIL, 4.0), (SPELT_EMAIL, 3.0)):
        for m in pattern.finditer(text):
            yield Mention("email", m.start(), m.end(), score)


def account_spans(text: str) -> list[tuple[int, int]]:
    """Bank accounts and payment cards, by mod-97, or by their form after their name, and by Luhn: their digits are no other number."""
    spans = [m.span() for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", "")) or _IBAN_CUE.search(text, max(0, m.start() - 12), m.start())]
    return spans + [m.span() for m in _CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0]))]


def _ids(text: str) -> Iterator[Mention]:
    for m in ANNOUNCED_ID.finditer(text):
        if sum(c.isdigit() for c in m[1]) >= 4:
            yield Mention("id_number", m.start(1), m.end(1), 4.5 + _checked(m[1]))
    for m in BARE_ID.finditer(text):
        score = (3.0 if m["ssn"] or m["nino"] else 1.5) + _checked(m[0])
        if _NO_PHONE.search(text, max(0, m.start() - 16), m.start()):
            score -= 2
        yield Mention("id_number", m.start(), m.end(), score)


def _phones(text: str) -> Iterator[Mention]:
    for m in PHONE.finditer(text):
        s, d = m[0], re.sub(r"\D", "", m[0])
        score = 1.0 if s.isdigit() else 3.0
        if not (9 if s[0] != "+" else 8) <= len(d) <= 15 and not (s.isdigit() and len(d) >= 7):
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        if _PHONE_CUE.search(before):
            score += 2
        if _NO_PHONE.search(before):
            score -= 2.5
        yield Mention("phone", m.start(), m.end(), score)


def _addresses(text: str) -> Iterator[Mention]:
    for m in ADDRESS.finditer(text):
        yield Mention("address", m.start(), m.end(), 4.0)


# -- persons -------------------------------------------------------------------

_WORDS = re.compile(rf"(?<![\w'’.@/\\-]){_CAP}(?:['’-]{_CAP}){{0,3}}(?![\w@/\\]|[-'’.]\w)|(?<![\w'’.@/\\-])[OD]['’]{_CAP}(?:-{_CAP}){{0,3}}(?![\w@/\\]|[-'’.]\w)")
_REST = re.compile(rf"((?:{_SPACE}[A-ZÀ-Þ]\.){{0,3}})((?:{_SPACE}{_PARTICLE}){{0,3}}){_SPACE}({_SURNAME})(?![\w@/]|[-'’.]\w)")
_INITIAL = re.compile(rf"(?<![\w.'’-])[A-ZÀ-Þ]\.(?:{_SPACE}?[A-ZÀ-Þ]\.){{0,2}}((?:{_SPACE}{_PARTICLE}){{0,3}}){_SPACE}?({_SURNAME})(?![\w@/]|[-'’.]\w)")
_COMMA = re.compile(rf",{_SPACE}({_CAP}(?:-{_CAP})?)(?![\w@/]|[-'’.]\w)")
_PARTICLES_BEFORE = re.compile(rf"(?<!\w)(?:{_PARTICLE}{_SPACE}){{1,3}}$")
_CAMEL = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]")
_NOBLE = re.compile(r"(?:[OD]['’]|Mc|Mac|Le|La|De|Van|Di|Fitz)(?=[A-ZÀ-Þ])")

_TITLED = re.compile(rf"(?<!\w)({_TITLE}){_SPACE}$")
_ASKED = (
    r"ask|asked|contact|colleague|customer|client|dear|thanks|attn|cc|manager|engineer|author|owner|reviewer|assignee|teammate|user|name|signed|"
    r"bitte|kunde|kundin|kollege|kollegin|frag|fragt|cliente|colega|señor|señora|llamar a|llame a|pregunta a|contact sheet|profile of"
)
#: What stands before a person: roles, requests and agents of a passive; then prepositions, which stand before much else.
_PERSON_BEFORE = re.compile(
    rf"(?i:(?<!\w)(?:{_ASKED})[:=,]?|(?<!\w)\w+ed(?:[ -]by)?[:,]|(?<!\w)\w+ed by|(?<!\w)\w+[ai]d[oa] por|"
    rf"(?<!\w)(?:met|meet|meeting|spoke|speak|talked|talk|chat|call|paired|pairing|work|working|worked|thanks|according|mail|message|notes|feedback|request|question) (?:with|to|from)){_SPACE}?$"
)
_WEAK_BEFORE = re.compile(rf"(?i:(?<!\w)(?:with|by|from|to|for|of|via|and|mit|von|an|für|und|con|por|para|de|a|y)){_SPACE}$|[(:|/]{_SPACE}?$")
#: What stands after a person: verbs of speaking and agreeing; then what often follows one.
_PERSON_AFTER = re.compile(
    rf"(?i:{_SPACE}(?:said|says|wrote|writes|asked|asks|told|tells|thinks|knows|confirmed|helped|agreed|approved|reviewed|reported|replied|suggested|noticed|mentioned|explained|called|"
    r"signed|joined|wants|escribe|escribió|dijo|dice|pide|pregunta|confirma|sagt|sagte|schreibt|schrieb|meint|fragen|bittet)\b)"
)
_WEAK_AFTER = re.compile(rf"(?i:{_SPACE}(?:has|had|is|was|will|can|on|from|and|\w{{2,}}ed|hat|al)\b|{_SPACE}?[(<;/|,])")


def _whole(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def _lexicon(path: str) -> dict[str, int]:
    """Rank of each word that the vocabulary holds whole, as it is spelt after a blank; frequent words rank low."""
    return {t[1:].decode(): r for t, r in vocabulary_ranks(path).items() if t[:1] == b" " and (t.isascii() or _whole(t)) and t[1:].decode().isalpha()}


@lru_cache(maxsize=1 << 16)
def word_weight(word: str, path: str = VOCABULARY) -> float:
    """1 for a word that is known with a capital only, 0.75 for one known rather so, 0.5 for an unknown one, less for ordinary words, -2.5 for function words."""
    if word.casefold() in CLOSED:
        return -2.5
    known = _lexicon(path)
    low, high = known.get(word.lower()), known.get(word[:1].upper() + word[1:].lower())
    if low is None:
        acronym = word.isupper() and word.isascii() and (len(word) < 4 or word in known)
        return -1.0 if acronym and high is None else 1.0 if high is not None else 0.5
    if high is not None and high < low:
        return 0.75
    return 0.25 if high is not None and high < 2 * low else -1.5


def _name_weight(word: str, lowered: set[str], path: str) -> float:
    """The weight of a given or family name by its last part; a word that the text has in lower case as well is ordinary, and one of inner capitals a program's."""
    part = re.split(r"['’-]", word)[-1]
    weight = word_weight(part, path)
    if _CAMEL.search(_NOBLE.sub("", word)):
        weight -= 3.0
    elif weight > -1 and part.lower() in lowered:
        weight -= 1.5
    return weight - 0.25 * (len(part) < 3)


def _folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isalnum())


_GAP = re.compile(r"[\s,;/|(<:=-]{1,4}(?:[^\W\d_][\w'. ]{0,20}[\s:=#(]{1,3})?|\s?\w{2,4}\s")
_LOWER_WORD = re.compile(r"(?<![\w@.-])[a-zß-ÿ][^\W\d_]*(?![\w@.-])")


class _Person:
    """Scores spans of one text as names; ``others`` are its mentions of other kinds in order of their start."""

    def __init__(self, text: str, others: list[Mention], path: str) -> None:
        self.text, self.others, self.path, self.starts = text, others, path, [m.start for m in others]
        self.lowered = set(_LOWER_WORD.findall(text))
        self.locals = {_folded(p) for m in others if m.pii_type == "email" for p in re.split(r"[\W_]+", re.split(r"@|[(\[{ ]+at\b", text[m.start : m.end])[0])}

    def around(self, start: int, end: int, name: str) -> float:
        text = self.text
        score, before = 0.0, text[max(0, start - 40) : start]
        title = _TITLED.search(before)
        if title:
            score += 1.25 if title[1].rstrip(".") in ("Miss", "Don") else 2.0
            before = before[: title.start()]
        if _PERSON_BEFORE.search(before):
            score += 1.5
        elif _WEAK_BEFORE.search(before):
            score += 0.5
        if _PERSON_AFTER.match(text, end):
            score += 1.5
        elif _WEAK_AFTER.match(text, end):
            score += 0.5
        k = bisect_left(self.starts, end)
        gaps = [text[self.others[k - 1].end : start]] if k else []
        gaps += [text[end : self.starts[k]]] if k < len(self.starts) and self.starts[k] - end <= 28 else []
        score += any(_GAP.fullmatch(g) for g in gaps if len(g) <= 28)
        return score + 1.5 * (_folded(name) in self.locals)

    def find(self) -> Iterator[Mention]:
        text = self.text
        for m in _WORDS.finditer(text):
            weight = _name_weight(m[0], self.lowered, self.path) - 2.0 * (m[0].casefold() in PLACE_LEADS)
            if weight <= -1:
                continue
            at, best, here = m.end(), None, weight
            for _ in range(3):
                n = _REST.match(text, at)
                if not n:
                    break
                more = _name_weight(n[3], self.lowered, self.path)
                if best is not None and more < 0.5:
                    break
                extra = 1.25 * bool(n[1]) + 0.5 * (bool(n[2]) + ("-" in n[3] or bool(_NOBLE.match(n[3]))))
                score = here + more + extra + self.around(m.start(), n.end(), n[3])
                if best is None or score > best.score - 0.75:
                    best = Mention("person", m.start(), n.end(), score)
                at, here = n.end(), here + 0.5
            if best:
                yield best
            c = _COMMA.match(text, m.end())
            if c and weight >= 0.5:
                given = _name_weight(c[1], self.lowered, self.path)
                lead = _PARTICLES_BEFORE.search(text, max(0, m.start() - 20), m.start())
                start = lead.start() if lead else m.start()
                if given >= 0.5:
                    near = self.around(start, c.end(), m[0])
                    yield Mention("person", start, c.end(), weight + given + near - 0.5 * (near < 1.5))  # else a list of places is one
        for m in _INITIAL.finditer(text):
            yield Mention("person", m.start(), m.end(), 1.5 + _name_weight(m[2], self.lowered, self.path) + 0.5 * bool(m[1]) + self.around(m.start(), m.end(), m[2]))


def _strongest(found: list[Mention], taken: list[tuple[int, int]]) -> list[Mention]:
    """Of overlapping proposals the higher score stays, of equal ones the longer, then the earlier; ``taken`` spans go before all. In order of their start."""
    spans = sorted(taken)
    kept: list[Mention] = []
    for m in sorted((m for m in found if m.score >= THRESHOLD), key=lambda m: (-m.score, m.start - m.end, m.start)):
        k = bisect_left(spans, (m.end, m.end))
        if k == 0 or max(end for _, end in spans[max(0, k - 2) : k]) <= m.start:
            insort(spans, (m.start, m.end))
            kept.append(m)
    return sorted(kept, key=lambda m: m.start)


def find_mentions(text: str | None, path: str = VOCABULARY) -> list[Mention]:
    """Mentions of personal data in order of their start; they do not overlap. Null and empty texts have none.

    Confirmed account and card numbers own their digits. Names are looked for last, beside and never within the other mentions.
    ``path`` is the vocabulary file of a public tokenizer, in rank form.
    """
    if not text:
        return []
    found: list[Mention] = []
    owned: list[tuple[int, int]] = []
    if "@" in text or "at" in text.lower():
        found += _emails(text)
    if any(map(text.__contains__, "0123456789")):
        owned = account_spans(text)
        found += _ids(text)
        found += _phones(text)
        found += _addresses(text)
    others = _strongest(found, owned)
    persons = _strongest(list(_Person(text, others, path).find()), [(m.start, m.end) for m in others])
    return sorted(others + persons, key=lambda m: m.start)


def redact(text: str | None, path: str = VOCABULARY) -> str | None:
    """The text with each mention replaced by a placeholder of its type, such as ``[EMAIL]``; all else unchanged, null stays null."""
    return _replaced(text, find_mentions(text, path))


def _replaced(text: str | None, found: list[Mention]) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for m in found:
        out += [text[at : m.start], f"[{m.pii_type.upper()}]"]
        at = m.end
    return "".join([*out, text[at:]])


def text_fields(df: DataFrame, tbl: str, key: str, fields: list[str]) -> DataFrame:
    """(tbl, record_id, field_name, text): one row for each field that is not null."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("record_id"), F.explode(cells).alias("c")).select("tbl", "record_id", "c.*").where("text IS NOT NULL")


def mentions(texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(tbl, record_id, field_name, pii_type, start_at): one row for each mention in ``texts`` (see :func:`text_fields`).

    start_at counts characters from 0. Texts are read whole; repeated rows give repeated mentions; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, starts = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for m in find_mentions(text, path):
                    rows.append(i)
                    kinds.append(m.pii_type)
                    starts.append(m.start)
            picked = b.select(["tbl", "record_id", "field_name"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(kinds, pa.string()), pa.array(starts, pa.int32())], ["tbl", "record_id", "field_name", "pii_type", "start_at"])

    schema = f"tbl string, record_id {texts.schema['record_id'].dataType.simpleString()}, field_name string, pii_type string, start_at int"
    return texts.select("tbl", "record_id", "field_name", "text").mapInArrow(run, schema)


def redacted(texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``texts`` with every mention replaced, and the number of mentions: (tbl, record_id, field_name, text, n_mentions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, counts = [], []
            for text in b.column("text").to_pylist():
                found = find_mentions(text, path)
                out.append(_replaced(text, found))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([*b.select(["tbl", "record_id", "field_name"]).columns, pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["tbl", "record_id", "field_name", "text", "n_mentions"])

    schema = f"tbl string, record_id {texts.schema['record_id'].dataType.simpleString()}, field_name string, text string, n_mentions int"
    return texts.select("tbl", "record_id", "field_name", "text").mapInArrow(run, schema)
