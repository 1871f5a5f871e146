"""Personal information inside free text: found, and replaced by typed pseudonyms.

Kinds: email, phone, id_number, address, person; in the replaced texts also account (bank account and card numbers) and birth_date. A find is
replaced by a placeholder that names its kind and carries a keyed pseudonym. Method for the pseudonyms: a Feistel network permutes the
digits of a number, and its letters, within their format, and a date among the dates of its calendar range, so ``415 555 0199`` becomes
another number of the same shape, equal values get equal pseudonyms in all documents, and without the key nothing can be read back. Of a
phone number the subscriber's digits are permuted, whatever stands before and behind them, so ``+1 415 555 0199`` and ``415 555 0199`` stay
linked. Names, mail and street addresses, which have no fixed format, get a keyed tag of their normalised form.

Finding rests on format checks (mail, phone, identity numbers, street and house number) with check digits, ranges and calendars where the format
has them, and, for names, on what stands around them, helped by a list of known name parts: family names are also recognised by the
beginnings and endings that the list's names are made of. The words that announce a find are sought in one pass by an automaton, and
patterns are tried only where one stands.

Scale: one Arrow pass over the documents, no shuffle; the name list is bounded by ``MAX_PARTS``. What stands before a mail address or behind
a name is looked at within ``REACH`` characters.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from datetime import date, timedelta
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens.shared import spread

MAX_PARTS = 200_000
ROUNDS = 10
REACH = 90
# Country calling codes of one and of two digits; all others have three.
_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

# -- pseudonyms -----------------------------------------------------------------------------------


class Pseudonyms:
    """Keyed permutations within a format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: str, i: int, half: int, size: int) -> int:
        h = hashlib.blake2b(f"{tag}|{i}|{half}|{size}".encode(), key=self.key, digest_size=16)
        return int.from_bytes(h.digest(), "big")

    def permute(self, value: int, size: int, tag: str, back: bool = False) -> int:
        """A permutation of ``range(size)``: a Feistel network on the next a * b >= size, walked until within."""
        if size <= 1:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            if not back:
                for i in range(ROUNDS):
                    if i % 2 == 0:
                        left = (left + self._round(tag, i, right, size)) % a
                    else:
                        right = (right + self._round(tag, i, left, size)) % b
            else:
                for i in reversed(range(ROUNDS)):
                    if i % 2 == 0:
                        left = (left - self._round(tag, i, right, size)) % a
                    else:
                        right = (right - self._round(tag, i, left, size)) % b
            value = left * b + right
            if value < size:
                return value

    def number(self, text: str, tag: str, back: bool = False) -> str:
        """Digits among digits and letters among letters of their case, everything else as it is."""
        out = list(text)
        for alphabet in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"):
            at = [i for i, c in enumerate(text) if c in alphabet]
            if at:
                base, value = len(alphabet), 0
                for i in at:
                    value = value * base + alphabet.index(text[i])
                value = self.permute(value, base ** len(at), f"{tag}{base}{len(at)}{alphabet[0]}", back)
                for i in reversed(at):
                    value, r = divmod(value, base)
                    out[i] = alphabet[r]
        return "".join(out)

    def date(self, d: date, first: date = date(1900, 1, 1), last: date = date(2099, 12, 31), back: bool = False) -> date:
        if not first <= d <= last:
            return d
        return first + timedelta(days=self.permute((d - first).days, (last - first).days + 1, "date", back))

    def phone(self, text: str, back: bool = False) -> str:
        """The subscriber's digits permuted; country code, a zero before the area and an extension stay, and make no difference."""
        at = [i for i, c in enumerate(text) if c in "0123456789"]
        ext = _EXTENSION.search(text)
        if ext:
            at = [i for i in at if i < ext.start()]
        digits = "".join(text[i] for i in at)
        skip = 0
        plus = "+" in text[: at[0]] if at else False
        if plus or digits.startswith("00"):
            skip = 0 if plus else 2
            skip += next((n for n in (1, 2) if digits[skip : skip + n] in _CODES), 3)
        if digits[skip : skip + 1] == "0":
            skip += 1
        elif not skip and len(digits) == 11 and digits[0] == "1":
            skip = 1
        at, out = at[skip:], list(text)
        if at:
            value = self.permute(int("".join(text[i] for i in at)), 10 ** len(at), f"phone{len(at)}", back)
            for i, c in zip(at, f"{value:0{len(at)}d}"):
                out[i] = c
        return "".join(out)

    def dated(self, text: str, back: bool = False) -> str:
        """A date in the spelling it has, permuted; what is no date stays."""
        found = read_date(text)
        if not found:
            return text
        d, spell = found
        return spell(self.date(d, back=back))

    def tag(self, text: str, kind: str) -> str:
        return hashlib.blake2b(f"{kind}|{plain(text)}".encode(), key=self.key, digest_size=5).hexdigest()


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).casefold()
    text = re.sub(r"%40|\s*[\[(]\s*at\s*[\])]\s*", "@", text)
    return re.sub(r"\s*[\[(]\s*dot\s*[\])]\s*", ".", re.sub(r"\s+", " ", text)).strip()


# -- mail -----------------------------------------------------------------------------------------
# Endings that make what follows an @ a file and not a host.
_FILE_ENDS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "js", "ts", "css", "py", "java", "go", "rs", "rb", "cs", "md", "txt", "json", "yaml", "yml", "git", "html", "xml"}
_LOCAL = r"[^\W_](?:[\w.+'’&-]*[^\W])?|[^\W_]"
_EMAIL = re.compile(
    r"(?<![\w.+/@%-])(?P<l>[^\W_](?:[\w.+'’&-]{0,62}\w)?)"
    r"(?:@|%40|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:AT|at)\s(?=[\w-]+\s(?:DOT|dot)\s))"
    r"(?P<h>[^\W_](?:[\w-]{0,61}[^\W_])?(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:DOT|dot)\s)[^\W_](?:[\w-]{0,61}[^\W_])?)*"
    r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:DOT|dot)\s)(?P<t>[^\W\d_]{2,24}))(?![\w-])"
)


_AT = re.compile(r"@|%40|[\[({<]\s?(?:at|AT|@)\s?[\])}>]|\s(?:AT|at)\s(?=[\w-]+\s(?:DOT|dot)\s)")


def find_email(text: str):
    done = 0
    for at in _AT.finditer(text):
        if at.start() < done or text[at.start() - 1 : at.start()] in ("", "\n"):
            continue
        low, end = max(done, at.start() - REACH), at.start() - text[at.start() - 1].isspace()
        start = end
        while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.+'’&-"):
            start -= 1
        while start < end and not text[start].isalnum():
            start += 1
        m = _EMAIL.match(text, start, min(len(text), at.end() + 260)) if start < end else None
        if m and m.end() > at.start():
            rest = text[m.end() : m.end() + 2]
            if m["t"].lower() in _FILE_ENDS or (m["l"] in ("git", "hg", "svn", "ssh", "deploy") and rest[:1] in (":", "/")):
                continue
            done = m.end()
            yield m.start(), m.end()


# -- phone ----------------------------------------------------------------------------------------
_EXT = r"(?:[ ,;]{0,2}(?:ext|extn|extension|x|Durchwahl|poste|Apdo)\.? ?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w.+/@#$%-])(?:tel:|callto:|sms:)?(?:"
    r"(?:\+|00)[ .-]?[1-9]\d{0,2}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,5}\)?){1,6}"
    r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}"
    r"|[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}"
    r"|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,5}|0\d{2,4}[ /]\d{5,9}|0\d{4}[ -]\d{6}|0\d[ .]\d{2}[ .]\d{2}[ .]\d{2}[ .]\d{2}"
    r")" + _EXT + r"(?![\w@]|[.:/-]\w)"
)
_EXTENSION = re.compile(r"(?:ext|extn|extension|x|Durchwahl|poste|Apdo)\.? ?\d{1,5}$")
_NOT_PHONE_BEFORE = re.compile(
    r"(?:\b(?:lines?|ports?|shards?|offset|version|rows?|pages?|pp?|object|commit|build|issue|job|ticket|id|run|between|chunks?|bytes|step|revision|rev|line|error|code|isbn|pin)\s*[:=#]?\s*)$",
    re.I,
)


def find_phone(text: str):
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in _EXTENSION.sub("", m.group()))
        start = m.start()
        if not 8 <= digits <= 15:
            continue
        before = text[max(0, start - 24) : start]
        if _NOT_PHONE_BEFORE.search(before):
            continue
        yield start, m.end()


# -- identity numbers -----------------------------------------------------------------------------
# What announces an identity number, in four languages.
_ID_CUES = (
    r"SSN|social(?:\s+(?:security|insurance))?(?:\s+(?:number|no\.?|num\.?|id))?|(?:NINO|NIN|NIF|NIE|NIR|NI|SIN|TIN|ITIN|EIN|UTR|DNI|CURP|RFC|CPF|BSN|PESEL|AHV|IdNr|USt-?Id(?:Nr)?)(?:\s*(?:number|no\.?|nr\.?))?"
    r"|national\s+(?:insurance|identity|id)(?:\s+(?:number|no\.?))?|insurance\s+(?:number|no\.?|id|policy)|health\s+insurance(?:\s+(?:number|no\.?))?|policy\s+(?:number|no\.?)"
    r"|passport(?:\s+(?:number|no\.?|nr\.?|id))?|tax(?:payer)?\s+(?:id|number|no\.?|reference|identification(?:\s+number)?|file\s+number)|TFN"
    r"|(?:driving|driver'?s?|drivers)?\s*licen[cs]e(?:\s+(?:number|no\.?|id))?|identity\s+(?:card|number|no\.?)(?:\s+(?:number|no\.?))?|ID\s+(?:card|number|no\.?)"
    r"|Sozialversicherungsnummer|Versicherungsnummer|Krankenversicherungsnummer|Steuer-?(?:ID|nummer|identifikationsnummer)|Reisepass(?:nummer|-?Nr\.?)?|Personalausweis(?:nummer|-?Nr\.?)?|Ausweis(?:nummer|-?Nr\.?)|Führerschein(?:nummer|-?Nr\.?)?"
    r"|num[ée]ro\s+(?:de\s+)?(?:s[ée]curit[ée]\s+sociale|passeport|permis|fiscal)|passeport(?:\s+n[°o]\.?)?|permis(?:\s+de\s+conduire)?(?:\s+n[°o]\.?)?|n[°º]\s*fiscal"
    r"|n[úu]mero\s+(?:de\s+)?(?:seguro(?:\s+social)?|seguridad\s+social|pasaporte|licencia|identificaci[óo]n\s+fiscal)|pasaporte(?:\s+n[°ºo]\.?)?|licencia(?:\s+de\s+conducir)?"
)
_ID = re.compile(
    r"(?<![\w-])(?:" + _ID_CUES + r")(?:\s*(?:is|ist|est|es|was|:|=|#|\(|n[°o]\.?))*\s*[\"'`]?(?P<v>(?=[A-Z0-9]*[ .\-/]?[A-Z0-9 .\-/]*\d)[A-Z0-9](?:[ .\-/]?[A-Z0-9]){5,19})(?![\w])",
    re.I,
)
_ID_BARE = re.compile(
    r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2,5}9?\d{6}[A-Z]\d[A-Z]{2})(?![\w-]|\.\d)"
)


def _id_end(text: str, a: int, b: int) -> int:
    """Of a value matched without regard to case, the part made of capitals, digits and single separators."""
    m = re.compile(r"(?:[A-Z]{0,6}[ .\-/]?\d[A-Z0-9]*)(?:[ .\-/][A-Z]?\d[A-Z0-9]*)*(?:[ .\-/][A-Z](?![\w]))?|[A-Z0-9]{6,}").match(text, a, b)
    return m.end() if m else a


def automaton(words: str) -> ahocorasick.Automaton:
    """Finds the words of a list in texts of lower case; a bar divides them."""
    out = ahocorasick.Automaton()
    for w in words.split("|"):
        out.add_word(w, w)
    out.make_automaton()
    return out


def announced(text: str, words: ahocorasick.Automaton) -> list[int]:
    """Where words of a list begin that aren't the rest of a longer word."""
    low, out = same_length_lower(text), set()
    for end, word in words.iter(low):
        start = end - len(word) + 1
        if not start or not (low[start - 1].isalnum() or low[start - 1] == "_"):
            out.add(start)
    return sorted(out)


def same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: How the words begin that announce an identity number.
_ID_AT = automaton(
    "ssn|social|nin|nif|nie|nir|ni|sin|tin|itin|ein|utr|dni|curp|rfc|cpf|bsn|pesel|ahv|idnr|ust|national|insurance|health|policy|passport|tax|tfn|driv|licen|identity|id |id\t|id\n"
    "|sozialv|versicherungs|krankenv|steuer|reisepass|personalausweis|ausweis|führerschein|numéro|numero|passeport|permis|n°|nº|número|pasaporte"
)


def is_social(text: str) -> bool:
    """Whether ddd-dd-dddd may be a social security number, or one for tax payers without (900 and more)."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and group != "00" and serial != "0000"


def around(text: str, spans, before: int, after: int) -> list[tuple[int, int]]:
    """The spans widened to whole lines, with some lines before and after, and merged."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and b <= out[-1][1]:
            continue
        for _ in range(before + 1):
            a = text.rfind("\n", 0, max(a, 0))
        for _ in range(after + 1):
            b = text.find("\n", b) + 1 or len(text)
        a = max(a + 1, 0)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_id(text: str):
    seen, done = [], 0
    for start in announced(text, _ID_AT):
        if start >= done and (m := _ID.match(text, start)):
            done = m.end()
            a, b = m.span("v")
            b = _id_end(text, a, b)
            if sum(c.isdigit() for c in text[a:b]) >= 5:
                seen.append((a, b))
    taken = Spans(seen)
    for m in _ID_BARE.finditer(text):
        if (m.group()[3] != "-" or is_social(m.group())) and taken.free(*m.span()):
            seen.append(m.span())
    yield from seen


# -- accounts and birth dates -----------------------------------------------------------------------
_IBAN = re.compile(r"[A-Z]{2}(?<![\w-]..)\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w])")
_CARD = re.compile(r"\d(?<![\w.+/-].)(?:[ -]?\d){12,18}(?![\w-]|\.\d)")


def is_iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def is_card(text: str) -> bool:
    """Luhn's check digit, and one of the first digits that cards have."""
    d = [int(c) for c in text if c.isdigit()]
    twice = sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    return d[0] in (3, 4, 5, 6) and (sum(d[-1::-2]) + twice) % 10 == 0 and len(set(d)) > 1


def find_account(text: str):
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start() + 14 and not is_iban(text[m.start() : end]):
            end -= 1
        if end > m.start() + 14:
            yield m.start(), end
    yield from (m.span() for m in _CARD.finditer(text) if is_card(m.group()))


_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d)"
_BORN = re.compile(
    r"\b(?:born|date of birth|d\.?o\.?b\.?|birth ?(?:date|day)|geboren|geb\.|Geburts(?:datum|tag)|née? le|date de naissance|nacid[oa]|fecha de nacimiento)"
    r"(?:\s*(?:on|is|was|am|el|the|ist|est|es|:|=|->|\())*\s*(?P<d>" + _DATE + ")",
    re.I,
)


def read_date(text: str):
    """A valid date and how to spell another one likewise; None if it is none. a/b/year is month first unless that can't be."""
    m = re.fullmatch(r"(\d+)([-./])(\d+)\2(\d+)", text)
    if not m:
        return None
    x, sep, y, z = m.groups()
    order = {"-": "ymd", ".": "dmy"}.get(sep, "dmy" if int(x) > 12 else "mdy")
    part = dict(zip(order, (x, y, z)))
    try:
        d = date(int(part["y"]), int(part["m"]), int(part["d"]))
    except ValueError:
        return None
    width = {k: len(v) if v[0] == "0" or len(v) > 2 else 1 for k, v in part.items()}
    return d, lambda n: sep.join(f"{ {'y': n.year, 'm': n.month, 'd': n.day}[k]:0{width[k]}d}" for k in order)


_BORN_AT = automaton("born|date of birth|dob|d.o.b|birth|geboren|geb.|geburts|né|date de naissance|nacid|fecha de nac")


def find_birth(text: str):
    yield from (m.span("d") for at in announced(text, _BORN_AT) if (m := _BORN.match(text, at)) and read_date(m["d"]))


class Spans:
    """Spans that don't overlap, in order."""

    def __init__(self, spans=()):
        self.at: list[tuple[int, int]] = sorted(spans)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.at, (a, math.inf))
        return not ((i and self.at[i - 1][1] > a) or (i < len(self.at) and self.at[i][0] < b))

    def add(self, a: int, b: int) -> None:
        self.at.insert(bisect_right(self.at, (a, b)), (a, b))


# -- street and number ----------------------------------------------------------------------------
_CAP = r"(?:[A-ZÀ-ÖØ-ÞŁŠŽČŚŹŻ][\w'’]*(?:-[A-ZÀ-Þ][\w'’]*)*)"
# Words for streets.
_STREET_AFTER = (
    r"(?:Street|St|Avenue|Ave|Av|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Terrace|Ter|Terr|Place|Pl|Square|Sq|Way|Parkway|Pkwy|Highway|Hwy|Hill|Rise|Close|Crescent|Cres|Row|Walk|Gardens|Gdns|Grove|Mews|Alley|Circle|Cir|Trail|Quay|Wharf|View|Green|Park|Path|Plaza|Loop|Esplanade|Broadway|Turnpike|Bridge|Gate|Yard|Fields?|Heights|Point|Ridge|Vale|Passage|Drove|Causeway)"
)
# Nouns that make a title or a thing of a street's name.
_TITLES = "Maps?|Warriors?|Trips?|Runners?|Shows?|Bands?|Races?|Rage|Festivals?|Heroes|Hero|Songs?|Albums?|Books?|Movies?|Games?|Series|Journals?|Signs?|Works?"
_NUMBER_FIRST = re.compile(
    r"(?<![\w.,:/$€£#@=+-])(?<!\d )\d{1,5}(?:[ ]?[A-Za-z](?![\w]))?(?:\s?[-–/]\s?\d{1,5}[A-Za-z]?)?(?:\s(?:bis|ter|quater))?,?[ \t]+"
    r"(?:(?:North|South|East|West|N|S|E|W)\.?[ \t]+)?(?:" + _CAP + r"[ \t]+){1,4}" + _STREET_AFTER + r"(?:\b\.?)(?!\w|['’]\w|[ \t]+(?:items?|entries|rows|files|lines|tests|times|" + _TITLES + r")\b)"
)
_FRENCH = re.compile(
    r"(?<![\w.,:/$€£#@=+-])\d{1,4}(?:[ ]?(?:bis|ter|quater)|[A-Z](?=\W))?,?[ \t]+(?:rue|avenue|av\.|boulevard|bd|bvd|place|pl\.|chemin|ch\.|all[ée]e|impasse|quai|cours|route|rte|passage|square|faubourg|voie|sentier|esplanade|villa|cit[ée]|Rue|Avenue|Boulevard|Place|Chemin|Allée|Impasse|Quai|Cours|Route)"
    r"[ \t]+(?:(?:de|du|des|la|le|les|d['’]|l['’]|à|aux|au|sous|sur|en)[ \t]*){0,3}" + _CAP + r"(?:[ \t-]+(?:" + _CAP + r"|de|du|des|la|le|les))*"
)
_HOUSE = r"\d{1,4}(?:[ ]?[a-zA-Z](?![\w]))?(?:[-–/]\d{1,4}[a-zA-Z]?)?(?![\w]|[.:]\d|[ ]?(?:%|\w*s\b))"
_GERMAN = re.compile(
    r"(?<![\w-])(?:(?:(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Hinter|Vor)[ \t]+(?:(?:der|dem|den|die)[ \t]+)?(?:" + _CAP + r"[ \t]+){1,3})"
    r"|(?:(?:" + _CAP + r"[ \t-]+){0,3}" + r"(?:[A-ZÀ-ÞŁ][\w'’-]*?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|stieg|pfad|chaussee|graben|markt|hof|berg|gränd|gatan|vägen|gata|veien|gade|vej|straat|laan|plein|gracht|kade|katu|tie|utca)|Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer)[ \t]+))"
    + _HOUSE
)
_ROMANCE = re.compile(
    r"(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Paseo|P[ºo]\.?|Plaza|Pza\.?|Camino|Carrera|Carretera|Ronda|Travesía|Vía|Glorieta|Rambla|Cuesta|Via|Viale|Piazza|Corso|Vicolo|Largo|Strada|Rua|Praça|Travessa|Ulica|ul\.|Al\.)"
    r"[ \t]*(?:(?:de|del|de la|de las|de los|della|delle|dei|degli|di|da|do|dos|das|las|los|la|el)[ \t]+){0,2}" + _CAP + r"(?:[ \t]+(?:" + _CAP + r"|de|del|la|las|los|di|y|e))*,?[ \t]+(?:n[.º°o]*[ \t]?)?" + _HOUSE
)
#: What follows a street and number as part of the address.
_ADDRESS_TAIL = re.compile(
    r"(?:,?[ \t]+(?:#\s?\d{1,5}\w?|(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Fl|Rm|Room|Bldg|App|Appt|Wohnung|Piso)\.?[ \t]?#?\w{1,5}|\d{1,2}[ºª°](?:[ \t]?[A-Z])?))?"
    r"(?:,[ \t]*\n?[ \t]*(?:\d{4,5}[ \t]+)?" + _CAP + r"(?:[ \t]+" + _CAP + r"){0,2}(?:,?[ \t]+[A-Z]{2}(?=[ \t]+\d{5}))?(?:[ \t]+\d{4,5}(?:-\d{4})?(?!\d))?)?"
)


_RUN = re.compile(r"\d+")
_ROMANCE_AT = automaton("calle|c/|avenida|avda|av.|paseo|po.|po |pº|plaza|pza|camino|carrera|carretera|ronda|travesía|vía|glorieta|rambla|cuesta|via|piazza|corso|vicolo|largo|strada|rua|praça|travessa|ulica|ul.|al.")
_GERMAN_IN = automaton(
    "straße|strasse|str.|weg|gasse|platz|allee|ufer|damm|ring|steig|stieg|pfad|chaussee|graben|markt|hof|berg|gränd|gatan|vägen|gata|veien|gade|vej|straat|laan|plein|gracht|kade|katu|tie|utca"
)
_GERMAN_AT = automaton("am |an |im |in |auf |zum |zur |unter |hinter |vor |am\t|an\t|im\t|in\t|auf\t|zum\t|zur\t|unter\t|hinter\t|vor\t")


def _addressed(text: str):
    """Matches of the address patterns; they hold a number, at their beginning or at their end."""
    for n in _RUN.finditer(text):
        for pattern in (_NUMBER_FIRST, _FRENCH):
            if m := pattern.match(text, n.start()):
                yield m
    for at in announced(text, _ROMANCE_AT):
        if m := _ROMANCE.match(text, at):
            yield m
    for at in announced(text, _GERMAN_AT):
        if text[at].isupper() and (m := _GERMAN.match(text, at)):
            yield m
    # the street's word stands last: its name is sought on the lines where a blank and a digit follow such a word
    low = same_length_lower(text)
    ends = [e for e, _ in _GERMAN_IN.iter(low) if low[e + 1 : e + 2] in (" ", "\t") and low[e + 1 : e + 20].lstrip()[:1].isdigit()]
    for a, b in around(text, ((e, e) for e in ends), 0, 0):
        yield from _GERMAN.finditer(text, a, b)


def find_address(text: str):
    for m in _addressed(text):
        end = m.end()
        if text[end - 1] == "." and not re.search(r"\b(?:St|Ave|Av|Rd|Ln|Ct|Dr|Blvd|Ter|Terr|Pl|Sq|Pkwy|Hwy|Cres|Gdns|Cir)\.$", text[m.start() : end]):
            end -= 1
        tail = _ADDRESS_TAIL.match(text, end)
        last = tail.end() if tail else end
        more = re.search(r"[ \t]+(?:The|If|When|Where|While|It|A|An|No|We|On|In|Why|Please|Both|Half|Send|Our|Write|Ask|Hi)$", text[end:last])
        yield m.start(), end + more.start() if more else last


# -- names ----------------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_T = rf"(?:[{_UP}](?:['’][{_UP}])?[^\W\d_]+|[{_UP}]['’][{_UP}][^\W\d_]+)"  # a capitalised word
_TT = rf"{_T}(?:-{_T})*"
_I = rf"[{_UP}]\."
_G = r"[ \t]+"
_GN = r"(?:[ \t]*\r?\n[ \t]*(?:[>#*|]+[ \t]*|//[ \t]*)?|[ \t]+)"
_PARTICLE = r"(?:(?:von|van|der|den|de|del|della|di|da|la|le|du|dos|ten|ter|zu|af|al|el|bin|ibn|Mc|Mac|St\.)[ \t]+){0,2}(?:(?:al|el|ad|ar|as)-)?"


def _name(gap: str) -> str:
    return (
        rf"(?:{_TT},{gap}{_TT}(?:{_G}{_I})?(?![\w@])"
        rf"|(?:{_I}{gap}?){{1,3}}{_PARTICLE}{_TT}"
        rf"|{_TT}{gap}(?:{_I}{gap}){{0,2}}{_PARTICLE}{_TT}"
        rf"|{_TT})"
    )


_N, _NW = _name(_G), _name(_GN)
_N_NO_COMMA = rf"(?:(?:{_I}[ \t]?){{1,3}}{_PARTICLE}{_TT}|{_TT}{_G}(?:{_I}{_G}){{0,2}}{_PARTICLE}{_TT}|{_TT})"
_N2 = rf"{_TT}(?:{_G}{_I}){{0,2}}{_G}{_PARTICLE}{_TT}(?:{_G}{_TT})?(?![\w@])"
# What people are to each other.
_WHO = "colleague|coworker|co-worker|manager|boss|friend|teammate|wife|husband|partner|brother|sister|daughter|son|father|mother|cousin|neighbou?r|doctor|teacher|lawyer|landlord|assistant|supervisor|mentor|intern|patient|tenant|engineer|developer|designer|analyst|contractor|director|professor|nurse|consultant"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Herrn|Frau|Mme|M\.|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora|Don|Doña)\.?[ \t]+)?"
# Words that begin sentences and lines and are no names.
_NO_NAME = {
    w.lower()
    for w in (
        "The A An If When Where While Why What Which Who How It This That These Those There Here No Not Nothing Nobody Both Half Each Every All Any Some"
        " Please Pin Set See Use Used Using During Between Before After Because Since Until Unless Although Though Even Only Again Then Than And Or But So As At By For From In Into Of Off On Onto Out"
        " Over To Under Up With Without Is Are Was Were Be Been Has Have Had Do Does Did Can Could May Might Must Shall Should Will Would I We You He She They My Our Your"
        " Memory Lines Line Ports Port Offset Object Version Commit Tests Test Row Rows Half Log Job Jobs Path Paths Road Map Note Notes Todo Fixme Warn Warning Info Debug Error Fatal Trace"
        " Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December Today Yesterday Tomorrow"
        " Team All Everyone Everybody Folks Support Admin Root User Users Customer Client Owner Author Reviewer Nobody Someone Anyone Hi Hello Dear Hey Thanks Thank Regards Best Cheers Sincerely"
        " Der Die Das Den Dem Des Ein Eine Einen Und Oder Aber Wenn Weil Bitte Ohne Mit Für Von Im Am Ist Warum Alle Le La Les Un Une Des Et Ou Mais Pour Sans Avec Dans Sur Il Elle On El Los Las Una Y O Pero Para Por Sin Con En Falta"
        " Index Filter Scheduler Store Router Warden Ledger Mirror Cache Queue Worker Server Client Engine Loader Parser Walker Planner Ranker Embedder Chunker Service Manager Monitor Gateway Broker Proxy Daemon Agent Bot Tracker Vector Query Chunk Merge"
        " Github Gitlab Google Microsoft Linux Windows Mac Python Java Javascript Typescript Rust Ruby Go Docker Kubernetes Spark Null None True False Readme License Changelog"
    ).split()
}
_CUES = [
    # lines of version control, headers, forms
    rf"(?:^[ \t>*#/|-]*|(?<=[.!?;:] ))(?:[Ss]igned-off-by|[Rr]eported-by|[Rr]eviewed-by|[Aa]cked-by|[Tt]ested-by|[Cc]o-authored-by|[Ss]uggested-by|[Hh]elped-by|[Ff]ound-by|[Cc]ommitter|[Aa]uthor|[Mm]aintainer|[Rr]eporter|[Aa]ssignee|[Oo]wner|[Cc]ontact|[Rr]eviewer|[Aa]pprover|From|To|Cc|CC|Bcc|Name|Nombre|Nom|Von|An)[ \t]*(?::|->|=>|=)[ \t]*[\"']?{_TITLE}(?P<n>{_N})(?=[ \t]*(?:$|[,;<(|\"'\[\r]|-|/|[{_UP}]\w* ))",
    rf"\b(?:assignee|owner|reporter|author|reviewer|maintainer|contact|approver|lead|manager)[ \t]*(?:->|=>|:|=)[ \t]*[\"']?{_TITLE}(?P<n>{_N})",
    rf"(?:@|\\)(?:param|author|owner|maintainer|contact|since by)(?:[ \t]+owner)?[ \t]+(?P<n>{_N}|{_N_NO_COMMA})(?=[ \t]*(?:,|<|$|\(|\r))",
    rf"\b(?:name|owner|user|author|reporter|full_?name|customer|patient|employee|contact|assignee|recipient|sender|holder|person)[\"']?[ \t]*[:=][ \t]*[\"']?{_TITLE}(?P<n>{_N})(?=[\"',;|}}\r\n]|[ \t]+\w+=|$|[ \t]*[<(])",
    rf"(?:^[ \t>*-]*|(?<=[.!?;:] ))[Cc][Cc]:?[ \t]+(?P<n>{_N})(?P<more>(?:(?:,|[ \t]+(?:and|und|et|y|&))[ \t]+{_N})*)",
    rf"(?:^[ \t]*|(?<=[.!?;:] ))(?:--|—|–|~)[ \t]+(?P<n>{_N})(?=[ \t]*(?:\r?$|[,(<|]|[{_UP}`]))",
    rf"\b(?:[Ff]ound|[Rr]eported|[Ww]ritten|[Ff]ixed|[Ss]potted|[Rr]eviewed|[Aa]pproved|[Ss]ubmitted|[Rr]equested|[Ss]igned|[Aa]uthored|[Cc]reated|[Oo]pened|[Cc]losed|[Aa]ssigned)[ \t]+(?:by|to):?[ \t]+{_TITLE}(?P<n>{_N})(?=\s*(?:[).,;:\r\n]|$|on |at |in ))",
    rf"\b(?:[Rr]eviewed|[Ss]poke|[Tt]alked|[Dd]iscussed|[Cc]hecked|[Pp]aired|[Mm]et|[Aa]greed)[ \t]+(?:\w+[ \t]+)?with[ \t]+{_TITLE}(?P<n>{_NW})(?=\s+(?:yesterday|today|last|on|about|this|earlier|and|who|in)\b|[.,;])",
    # salutations
    rf"(?:^[ \t>*]*|(?<=[.!?;:] ))(?:[Hh]i|[Hh]ello|[Hh]ey|[Dd]ear|[Hh]allo|[Ll]ieber?|[Mm]oin|[Ss]ervus|[Gg]uten (?:Tag|Morgen)|[Bb]onjour|[Bb]onsoir|[Ss]alut|[Cc]h(?:er|ère)|[Hh]ola|[Qq]uerid[oa]|[Ee]stimad[oa]|[Bb]uenos días|[Cc]iao|[Gg]ood (?:morning|afternoon|evening))[ \t]+{_TITLE}(?P<n>{_N_NO_COMMA})(?P<more>(?:(?:,|[ \t]+(?:and|und|et|y|&))[ \t]+{_N_NO_COMMA})*)(?=[ \t]*(?:[,!:.]|\r?$|-|–|—))",
    rf"^[ \t>*]*(?:[Kk]ind regards|[Bb]est(?: regards| wishes)?|[Rr]egards|[Cc]heers|[Tt]hanks|[Ss]incerely|[Yy]ours(?: truly| sincerely| faithfully)?|[Ll]ove|[Tt]ake care|[Hh]ochachtungsvoll|[Hh]erzliche Grüße|[Aa]mitiés|[Uu]n abrazo|[Vv]iele Grüße|[Mm]it freundlichen Grüßen|[Gg]ruß|[Cc]ordialement|[Bb]ien à vous|[Ss]aludos|[Aa]tentamente)[,!]?[ \t]*\r?\n[ \t>]*(?P<n>{_N})(?=[ \t]*\r?$)",
    # sentences
    rf"\b(?:[Tt]hanks|[Tt]hank you|[Kk]udos|[Cc]redits?|[Mm]any thanks|[Dd]ank|[Dd]anke)[ \t]+(?:to|go to|an|for)[ \t]+{_TITLE}(?P<n>{_NW})(?=\s+(?:for|who|and|für)\b|[.,;!(]|[ \t]*$)",
    rf"\b(?:[Mm]erci|[Gg]racias|[Gg]razie|[Oo]brigad[oa])[ \t]+(?:à|a|al)[ \t]+{_TITLE}(?P<n>{_NW})(?=\s*(?:[,.(;!<]|$))",
    rf"\b[Bb]itte[ \t]+{_TITLE}(?P<n>{_NW})\s+(?:unter|per|über|fragen|anrufen|kontaktieren|informieren)\b",
    rf"\b(?:[Aa]sk|[Pp]ing|[Cc]all|[Ee]mail|[Mm]ail|[Mm]essage|[Nn]otify|[Tt]ell|[Cc]ontact|[Pp]hone|[Rr]ing|[Pp]age)[ \t]+{_TITLE}(?P<n>{_NW})(?=\s+(?:about|at|on|under|if|before|for|when|to|directly|via)\b|[ \t]*[,.(<])",
    rf"\b(?:[Oo]n|[Aa]m|[Ll]e|[Ee]l)[ \t]+(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)(?:day)?,?(?:[ \t]+[\d:, ./-]+)?[ \t]+(?P<n>{_NW})\s+(?:wrote|schrieb|said|asked)\b",
    rf"^(?P<n>{_N})[ \t]+(?:wrote|schrieb|escribió|a écrit)[ \t]*:",
    rf"\b(?:says|said|asks|asked|writes|wrote|according to|sagt|laut|dit|selon|dice|según)[ \t]+{_TITLE}(?P<n>{_NW})(?=\s*(?:[.,;:!?\r\n]|$))",
    rf"\bmerged[ \t]+(?P<n>{_NW})['’]s?\s+(?:patch|branch|change|fix|work|commit|test)",
    rf"\b[Aa]s[ \t]+(?P<n>{_NW})\s+(?:said|noted|wrote|put it|pointed|asked)\b",
    rf"\b[Aa]s[ \t]+(?P<n>{_NW})\s+and\s+(?=<?(?:mailto:)?<?[\w.+%'’-]+(?:@|%40|[ \t]?[\[(]at[\])]))",
    rf"\b(?:customer|client|user|tenant|patient|employee|colleague|Kunde|Kundin|cliente?)[ \t]*(?:\(|named[ \t]+)(?P<n>{_NW})(?=\s*[,);])",
    rf"\bfixture:[ \t]*(?P<n>{_NW})[ \t]*;",
    rf"\bVALUES[ \t]*\([^'\"\n]{{0,30}}['\"](?P<n>{_N})['\"]",
    rf"^[ \t]*\|[ \t]*(?P<n>{_N})[ \t]*\|(?=[^|\n]*(?:@|%40|[\[(]at[\])]|\d{{3}}))",
    rf"(?<=\d)[ \t]+#[ \t]*(?P<n>{_N})(?=[ \t]*(?:\r?$|[^\w\s,;]|[{_UP}`]))",
    rf"\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Ii] am|[Tt]his is|named|called)[ \t]+{_TITLE}(?P<n>{_N_NO_COMMA})(?=\s*(?:[.,;:!?]|and|from|$))",
    rf"\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora)\.?[ \t]+(?P<n>{_N_NO_COMMA})",
    # two words and more that are names by what people do with each other
    rf"\b(?:talk(?:ed|ing)?|sp(?:oke|eak|eaking)|met|meet(?:ing)?|chat(?:ted|ting)?|work(?:ed|ing|s)?|pair(?:ed|ing)|sat|dinner|lunch|listen(?:ed)?|wrote|married)[ \t]+(?:(?:with|to|up with)[ \t]+)?(?P<n>{_N2})",
    rf"\b(?i:my|our|his|her|their|your|the|a|former|new)[ \t]+(?:{_WHO}),?[ \t]+(?P<n>{_N2})",
]
#: A name of two words and more in front of what only people do or are.
_DOES = re.compile(
    rf"(?<![\w'’-])(?P<n>{_N2})[ \t]+(?:(?:has|had|have|will|would|also|just|recently|then|never|already)[ \t]+)*"
    rf"(?:moved?[ \t]+(?:to|from|in|out)|lives?|lived|work(?:s|ed)?[ \t]+at|was[ \t]+born|join(?:ed|s)?|told|e?-?mailed|phoned|texted|replie[sd]|answer(?:s|ed)|agree[sd]|thinks|thought|believes|believed"
    rf"|suggest(?:s|ed)|mention(?:s|ed)|ask(?:s|ed)|wrote|says|said|complained|apologi[sz]ed|retire[sd]?|resigned|called[ \t]+(?:me|us|him|her|back|in)|is[ \t]+(?:married|on[ \t]+(?:leave|vacation|holiday|call)|out[ \t]+of[ \t]+office|our|my|a[ \t]+(?:{_WHO}))|and[ \t]+(?:I|his|her)\b)"
)
#: For each cue the literals (in lower case) of which every match of its pattern holds one. ``at``: the match begins with it, so the
#: pattern is tried there only; ``line``: it is tried on the lines around it.
_TRIGGERS = [
    ("line", ":|->|="),
    ("at", "assignee|owner|reporter|author|reviewer|maintainer|contact|approver|lead|manager"),
    ("line", "param|author|owner|maintainer|contact|since by"),
    ("at", "name|owner|user|author|reporter|full_name|fullname|customer|patient|employee|contact|assignee|recipient|sender|holder|person"),
    ("line", "cc"),
    ("line", "--|—|–|~"),
    ("at", "found|reported|written|fixed|spotted|reviewed|approved|submitted|requested|signed|authored|created|opened|closed|assigned"),
    ("at", "reviewed|spoke|talked|discussed|checked|paired|met|agreed"),
    ("line", "hi |hi\t|hello|hey |hey\t|dear|hallo|liebe|moin|servus|guten|bonjour|bonsoir|salut|cher|chère|hola|querid|estimad|buenos|ciao|good"),
    ("line", "regards|best|cheers|thanks|sincerely|yours|love|take care|hochachtungsvoll|amitiés|un abrazo|grüße|gruß|cordialement|bien à|saludos|atentamente"),
    ("at", "thanks|thank you|kudos|credit|many thanks|dank"),
    ("at", "merci|gracias|grazie|obrigad"),
    ("at", "bitte"),
    ("at", "ask|ping|call|email|mail|message|notify|tell|contact|phone|ring|page"),
    ("line", "wrote|schrieb|said|asked"),
    ("line", "wrote|schrieb|escribió|a écrit"),
    ("at", "says|said|asks|asked|writes|wrote|according to|sagt|laut|dit|selon|dice|según"),
    ("at", "merged"),
    ("at", "as"),
    ("at", "as"),
    ("at", "customer|client|user|tenant|patient|employee|colleague|kunde|kundin"),
    ("at", "fixture:"),
    ("at", "values"),
    ("line", "|"),
    ("line", "#"),
    ("at", "my name is|ich heiße|je m'appelle|me llamo|i am|this is|named|called"),
    ("at", "mr|mrs|ms|mx|dr|prof|herr|frau|mme|mlle|monsieur|madame|señor"),
    ("at", "talk|spoke|speak|met|meet|chat|work|pair|sat|dinner|lunch|listen|wrote|married"),
    ("at", "my|our|his|her|their|your|the|a|former|new"),
]
_PATTERNS = [(re.compile(c, re.M), c) for c in _CUES]
_FIND = ahocorasick.Automaton()
for _i, (_how, _words) in enumerate(_TRIGGERS):
    for _w in (_words.split("|") if _words != "|" else ["|"]):
        _known = _FIND.get(_w, (_w, []))
        _known[1].append((_i, _how == "at"))
        _FIND.add_word(_w, _known)
_FIND.make_automaton()
assert len(_TRIGGERS) == len(_CUES)


def cued(text: str):
    """Matches of the cue patterns, with the number of the cue."""
    low, at, lines = same_length_lower(text), {}, {}
    for end, (word, cues) in _FIND.iter(low):
        start = end - len(word) + 1
        whole = not (start and (low[start - 1].isalnum() or low[start - 1] == "_"))
        for i, begins in cues:
            if not begins:
                lines.setdefault(i, []).append((start, end))
            elif whole:
                at.setdefault(i, set()).add(start)
    for i, starts in at.items():
        done = 0
        for a in sorted(starts):
            if a >= done and (m := _PATTERNS[i][0].match(text, a)):
                yield i, m
                done = m.end()
    for i, spans in lines.items():
        for a, b in around(text, spans, 1 if i in (9, 14) else 0, 2):
            yield from ((i, m) for m in _PATTERNS[i][0].finditer(text, a, b))


#: What stands behind a name; the name is then sought backwards from there.
_BEHIND = re.compile(
    r"(?:['’]s?\s+(?:patch|test|branch|change|fix|work|commit|review|report|machine|laptop|account|desk|mail|note|comment)\b"
    r"|\s(?:moved|asked|reported|found|wrote|said|merged|broke|fixed|added|removed|changed|noticed|approved|reviewed|opened|closed|suggested|sent|called|joined|left|took)[ \t]+(?:the|a|an|that|this|it|us|me|for|in|our|my|last|out)\b)"
)
_BEFORE = re.compile(rf"(?<![\w'’-])({_NW})$")
_BEFORE_MAIL = re.compile(rf"(?<![\w'’-])({_N})[ \t]*[<(,|/][ \t]*(?:mailto:)?[ \t]*<?$")
_EACH = re.compile(_N)
_LOWER = re.compile(r"(?<![\w'’-])[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]*")
#: The cue whose further names may be written family name first, and those that things fit as well.
_COPY, _LOOSE = 4, (27, 28)
_EACH_PLAIN = re.compile(_N_NO_COMMA)
_WORDS = re.compile(rf"{_TT}|{_I}")


class _About(NamedTuple):
    given: bool
    family: bool
    stop: bool
    initial: bool


class NameParts:
    """Known name parts, and what family names are made of."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.given = {p.casefold() for p, k in parts if k == "given"}
        self.family = {p.casefold() for p, k in parts if k == "family"}
        heads, tails = Counter(), Counter()
        for f in self.family:
            for i in range(3, len(f) - 2):
                heads[f[:i]] += 1
                tails[f[i:]] += 1
        self.heads = {h for h, n in heads.items() if n >= 4}
        self.tails = {t for t, n in tails.items() if n >= 4}
        self.is_family = lru_cache(100_000)(self._is_family)
        self.about = lru_cache(100_000)(self._about)

    def __reduce__(self):
        return NameParts, ([*((p, "given") for p in self.given), *((p, "family") for p in self.family)],)

    def _about(self, word: str) -> "_About":
        return _About(self.is_given(word), self.is_family(word), word.lower() in _NO_NAME, bool(re.fullmatch(_I, word)))

    def _is_family(self, word: str) -> bool:
        for w in word.casefold().split("-"):
            if w in self.family:
                return True
            if any(w[:i] in self.heads and w[i:] in self.tails for i in range(3, len(w) - 2)):
                return True
        return False

    def is_given(self, word: str) -> bool:
        return all(w in self.given for w in word.casefold().split("-"))


def _words_of(name: str) -> list[str]:
    return re.findall(r"[^\s,]+", name)


# Of the words above, short ones that may also be a given name where a family name follows.
_MAYBE = {"la", "le", "el", "los", "las", "das", "der", "die", "den", "dem", "des", "un", "une", "una", "sin", "con", "en", "et", "il", "on", "sur", "am", "im", "mit", "von", "ein", "mais", "ou", "o", "y", "no", "he", "it", "to", "an", "at", "by", "is", "we", "if", "she", "you", "has", "was", "did", "can", "para", "per", "job", "mac", "max", "or", "may", "april", "june", "august", "do", "of", "as", "in", "go", "be", "so"}


def _trim(name: str) -> int:
    """Length of the name without trailing words that are none; 0 if it begins with such a word."""
    words = list(re.finditer(r"[^\s,]+", name))
    lower = [w.group().lower() for w in words]
    keep = len(words)
    for i in range(1, len(words)):
        if lower[i] in _NO_NAME and not re.fullmatch(_I, words[i].group()):
            keep = i
            break
    if not re.fullmatch(_I, words[0].group()) and lower[0] in _NO_NAME and (keep == 1 or lower[0] not in _MAYBE):
        return 0
    if keep == 1 and re.fullmatch(_I, words[0].group()):
        return 0
    return words[keep - 1].end()


def find_person(text: str, parts: NameParts, mails: list[int]):
    """Names by what stands around them, and known given names or initials with a family name.

    Of a pair of which the second word is a common noun (a product's name, say) nothing is a name. ``mails`` are the
    starts of mail addresses, before which a name may stand.
    """
    found: list[tuple[int, int]] = []

    def add(a: int, name: str, product_rule: bool = True) -> None:
        n = _trim(name)
        if not n:
            return
        words = [w.strip(".,") for w in _words_of(name[:n])]
        whole = [w.strip(".,") for w in _words_of(name)]
        # "Reed Filter": the word cut off belongs to it, so this is the name of a thing
        if product_rule and len(whole) > len(words) == 1 and not name[n:].lstrip().startswith(("If", "The", "It", "A ", "An ", "On", "No", "In")):
            nxt = whole[1].lower()
            if nxt in _THINGS:
                return
        found.append((a, a + n))

    def loose(m: re.Match) -> None:
        """A find of a pattern that things fit as well: no word of it may be a common one here."""
        name, lower = m.group("n"), None
        n = _trim(name)
        whole = [w.strip(".,") for w in _words_of(name[:n])]
        if len(whole) < 2 or n < len(name):
            return
        for w in whole:
            if re.fullmatch(_I, w + ".") or len(w) == 1:
                continue
            if w.lower() in _NO_NAME or w.lower() in _THINGS or w.isupper():
                return
            if not (parts.is_given(w) or parts.is_family(w)):
                lower = lower or set(_LOWER.findall(text))
                if w.lower() in lower:
                    return
        found.append((m.start("n"), m.start("n") + n))

    for i, m in cued(text):
        if i in _LOOSE:
            loose(m)
            continue
        add(m.start("n"), m.group("n"))
        if "more" in m.re.groupindex and m.group("more"):
            for x in (_EACH if i == _COPY else _EACH_PLAIN).finditer(m.group("more")):
                add(m.start("more") + x.start(), x.group())
    for m in _BEHIND.finditer(text):
        left = max(0, m.start() - REACH)
        if b := _BEFORE.search(text[left : m.start()]):
            add(left + b.start(1), b.group(1))
    for at in mails:
        left = max(0, at - REACH)
        if b := _BEFORE_MAIL.search(text[left:at]):
            add(left + b.start(1), b.group(1))
    # without a cue: both words must be known for names
    words = [(*m.span(), m.group()) for m in _WORDS.finditer(text)]
    about = parts.about
    for i in range(len(words) - 1):
        (a, x, w), (y, b, v) = words[i], words[i + 1]
        if not 0 < y - x <= 4:
            continue
        gap = text[x:y]
        if gap.strip(" \t\r\n") and gap.strip(" \t") != "," or gap.count("\n") > 1:
            continue
        if gap.isspace() and "\n" not in gap and (m := _DOES.match(text, a)):
            loose(m)
        comma = "," in gap
        first, last = (about(v), about(w)) if comma else (about(w), about(v))
        if first.stop or last.stop or not last.family:
            continue
        if first.given or (first.initial and not comma and "\n" not in gap):
            found.append((a, b))
    for i, (a, b, w) in enumerate(words):
        if len(w) < 5 or "-" in w or not about(w).family:
            continue
        # a family name by itself, beside a capitalised word that is no common one
        if i and words[i - 1][1] < a and not text[words[i - 1][1] : a].strip(" \t") and a - words[i - 1][0] <= 40 and not about(words[i - 1][2]).stop:
            found.append((words[i - 1][0], b))
    return found


# Nouns for things of software that stand second in a product's name.
_THINGS = {
    w.lower()
    for w in (
        "Index Filter Scheduler Store Router Warden Ledger Mirror Cache Queue Worker Server Client Engine Loader Parser Walker Planner Ranker Embedder Chunker Service Manager"
        " Monitor Gateway Broker Proxy Daemon Agent Bot Tracker Map Window Build Vector Query Chunk Merge"
    ).split()
}

#: What is sought; the last two only for replaced texts.
KINDS = ("email", "phone", "id_number", "address", "person", "account", "birth_date")


def find_all(text: str, parts: NameParts) -> list[tuple[int, int, str]]:
    """Non-overlapping finds (start, end, kind) in order. Where kinds overlap, mail, identity numbers, accounts, birth dates, addresses and phones go first."""
    taken, kinds = Spans(), {}

    def take(a: int, b: int, kind: str) -> None:
        if b > a and taken.free(a, b):
            taken.add(a, b)
            kinds[a] = kind

    if any(c.isdigit() for c in text) or "@" in text or "at" in text.lower():
        for kind, find in (("email", find_email), ("id_number", find_id), ("account", find_account), ("birth_date", find_birth), ("address", find_address), ("phone", find_phone)):
            for a, b in sorted(set(find(text)), key=lambda s: (s[0], -s[1])):
                take(a, b, kind)
    firm = list(taken.at)
    names = sorted(set(find_person(text, parts, [a for a, _ in firm if kinds[a] == "email"])), key=lambda s: (s[0] - s[1], s[0]))
    for a, b in names:
        # a name may run into a house number or a mail behind it
        i = bisect_right(firm, (a, math.inf))
        if i < len(firm) and firm[i][0] < b:
            b = a + len(text[a : firm[i][0]].rstrip(" ,;(<"))
        take(a, b, "person")
    return [(a, b, kinds[a]) for a, b in taken.at]


def replaced(text: str, finds: list[tuple[int, int, str]], names: Pseudonyms) -> str:
    """The text with each find replaced by ``<KIND pseudonym>``, all else unchanged."""
    out, last = [], 0
    how = {"phone": names.phone, "birth_date": names.dated, "id_number": lambda t: names.number(t, "id_number"), "account": lambda t: names.number(t, "account")}
    for a, b, kind in finds:
        new = how[kind](text[a:b]) if kind in how else names.tag(text[a:b], kind)
        out += [text[last:a], f"<{kind.upper()} {new}>"]
        last = b
    return "".join([*out, text[last:]])


def _name_parts(name_parts: DataFrame):
    rows = name_parts.where(F.col("part_text").isNotNull()).select("part_text", F.lower("part_kind").alias("k")).distinct().limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} name parts")
    parts = NameParts([(r.part_text.strip(), r.k or "family") for r in rows if r.part_text.strip()])
    return name_parts.sparkSession.sparkContext.broadcast(parts)


def _lines(text: str, finds: list[tuple[int, int, str]]) -> list[int]:
    """The line on which each find begins."""
    ends = [m.start() for m in re.finditer("\n", text)] if finds else []
    return [bisect_right(ends, a - 1) + 1 for a, _, _ in finds]


def personal_lines(documents: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, kind, line_no): the lines on which personal data begins, one row per line and kind; nothing is replaced.

    Lines end at ``\\n`` and are counted from 1. Null and empty texts have no finds; repeated rows count once; other columns are ignored.
    """
    parts = _name_parts(name_parts)

    def run(batches):
        for pdf in batches:
            rows = set()
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                if t:
                    finds = find_all(t, parts.value)
                    rows.update((d, k, n) for (_, _, k), n in zip(finds, _lines(t, finds)))
            yield pd.DataFrame(sorted(rows, key=str), columns=["doc_id", "kind", "line_no"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, kind string, line_no int").distinct()


def pseudonymised(documents: DataFrame, name_parts: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, finds): each document with its personal data replaced, and what was found where.

    Who knows ``key`` can read the numbers and dates back; texts replaced with the same key are linked. ``finds`` is an array of (kind,
    line_no, start_char, end_char) in the original text, lines ending at ``\\n`` and counted from 1.
    Null texts stay null with no finds, empty ones empty; other columns are ignored and repeated rows kept.
    """
    if len(key) < 16:
        raise ValueError("the key needs 16 bytes at least")
    parts = _name_parts(name_parts)
    schema = "doc_id long, text string, finds array<struct<kind: string, line_no: int, start_char: int, end_char: int>>"

    def run(batches):
        names = Pseudonyms(key)
        for pdf in batches:
            texts, all_finds = [], []
            for t in pdf["text"]:
                finds = find_all(t, parts.value) if t else []
                texts.append(replaced(t, finds, names) if finds else t)
                all_finds.append([{"kind": k, "line_no": n, "start_char": a, "end_char": b} for (a, b, k), n in zip(finds, _lines(t, finds))])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "finds": all_finds})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, schema)
