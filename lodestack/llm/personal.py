"""Personal information in free text: a semi-Markov conditional random field over candidate spans.

A text is segmented into personal data (email, phone, id_number, address, name) and the rest.  Only
spans that could be personal data (by a character pattern, or any run of capitalised words) are segments with
features; whether a word is a listed given name is one feature among them.  All else scores nothing, so the lattice of a text is as long as its candidates are many.
Features look at the whole span (its shape, digits, case, the suffix of a surname) and at the words
around it; a transition feature looks at the entity that ended just before.  Boundaries and types
are chosen jointly by exact dynamic programming over the lattice, in which a segment has at most MAX_SPAN
characters.

The weights are trained by gradient ascent on the exact log-likelihood (forward-backward over the
same lattice) of sentences drawn from templates in this file; no row of a table is used.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.language import FUNCTION_WORDS

TYPES = ("email", "phone", "id_number", "address", "name")
MAX_SPAN, NEAR = 120, 12  # characters of a segment; between two that are linked
EXAMPLES, EPOCHS, RATE = 1600, 6, 0.5
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def plain(word: str) -> str:
    word = word.lower().replace("ł", "l")
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


# Given names, lower case, without regard to accents.
GIVEN = frozenset(
    """adam adele agnes ahmed aisha alain albert alejandro alex alexander alice amelie amina ana andre andrea andreas angela anita anna anne anouk anton antonio ali
    aurelie baptiste beatriz ben benoit bernard bianca brigitte bruno camille carla carlos carmen carolina catherine cecile chiara chloe christian christine claire clara claude
    claudia cristina dagmar daniel daniela darius david diana diego dieter dmitri dominique edith eduardo elena elias elisa elise emil emilia emma enrique erik ernst esther eva
    fabien farid fatima fatou felix fernando florian francois frank franz frida gabriel gerard gilles giulia greta guillaume gustav hana hannah hans hassan heike heinz helena helene
    henri hugo ibrahim idris ilse ines ingrid irene isabel ivan jack jacques james jan jana javier jean jens joana joao johan johanna john jonas jordan jorge jose josef juan judith
    julia julie jurgen karim karin karl katarina kofi klaus laura lars leila lena leon leonie liam lina lisa louis louise lucas lucia luis luisa lukas malgorzata manuel marc marco
    marek margarita maria marie mario markus marta martin martina mathilde max mehmet michael michel miguel mireille miriam mohamed monika nadia natalia nicolas nicole nils nina noah
    nora olaf olga oliver olivier omar oscar pablo patricia paul paula pedro petra philippe pierre quentin rachel rania raul rene robert roberto rosa samir samuel sandra sara sarah
    sebastian serge sergio silvia simon sofia sophie stefan susanne tarek teresa tessa theo thomas tobias tomas ulla ulrich ursula valerie vera victor victoria viktor vincent wanda
    werner wim wolfgang xavier yara yasmin yusuf yves zeno zoe""".split()
)
# Endings of surnames, titles, particles and kinds of streets.
SURNAME = tuple("ado oglu strom ström en ier ward kamp ska ski vic vić dze etti elli ala aris aux eau hurst quist mann son sen ez ini ova ov off stein berg bauer meyer mayer man".split())
TITLE = re.compile(r"(?:^|(?<=[\s(\[{\"':|,/]))(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Mme|Mlle|M|MM|Monsieur|Madame|Herr|Herrn|Frau|Sr|Sra|Srta|Don|Doña|Señor|Señora)\.?\s+$", re.I)
PARTICLE = r"(?:de\s+la|de|del|di|da|du|van\s+der|van\s+den|van|von\s+der|von|zu|el|al|le|la|ben|bin|ter)"
NUMBERED = r"street|st|lane|ln|road|rd|avenue|ave|close|way|boulevard|blvd|drive|dr|court|ct|place|pl|terrace|crescent|gardens|square|grove|row|hill|mews|walk|parkway|circle"
ROAD_FR = r"rue|avenue|av\.|chemin|impasse|boulevard|bd|place|allée|quai|route|cours|passage|square|sentier|faubourg"
ROAD_ES = r"calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|travesía|callejón|via|vía"

AT = re.compile(r"[@＠]|[\[({][ \t]?(?:[aA][tT]|[aA]robase|[aA]rroba|AROBASE|ARROBA)[ \t]?[\])}]")
SPOKEN_AT = re.compile(r" (?:at|AT)[ \t](?=[\w-]+(?:\.|[ \t]?[\[({]?[ \t]?(?:dot|DOT)\b))")
LOCAL = re.compile(r"[^\W_][\w.+%-]{0,62}$|[^\W_]$")
DOT = r"(?:\.|[ \t]?[\[({][ \t]?(?:dot|point|punkt|punto)[ \t]?[\])}][ \t]?|[ \t](?:dot|DOT)[ \t])"
HOST = re.compile(rf"[^\W_][\w-]*(?:{DOT}[^\W_][\w-]*)+", re.I)
DIGITS = re.compile(r"(?<![\w.,/#@-])(?<!\d:)(?:\+[ ]?|\(\+?)?\d(?:[\d  (). /-]{4,22}\d)(?![\w]|[.,/-]\d)(?:[ ]?(?:ext|x|poste|app|durchwahl)\.?[ ]?\d{1,5})?", re.I)
PHONE_SHAPES = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d[\d .-]{5,14}\d|00\d{2}[\d .-]{7,14}|\(0?\d{2,4}\)[ ]?\d{3,4}[ -]?\d{3,4}|1[ -.]\d{3}[ -.]\d{3}[ -.]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|0\d{2,4}/\d{4,6}(?:[ -]\d{2,4})?|0\d(?:[ .-]?\d\d){4}|0\d{3}[ -]\d{2}[ -]\d{4}|0\d{4}[ -]?\d{3}[ -]?\d{3}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d{9,10}")
IDS = re.compile(
    r"(?<![\w-])(?=(?:[ -]?[A-ZÑ0-9]){8})(?:(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])|(?P<pass>[A-Z]{1,2}\d{7,8})|(?P<dni>\d{8}-? ?[A-ZÑ])|(?P<nie>[XYZ]-?\d{7}-?[A-Z])|(?P<nir>[1-478] ?\d\d ?(?:0\d|1[0-2]|[2-9]\d) ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d\d)?)|(?P<ssn>\d{3}(?P<sep>[- ])\d\d(?P=sep)\d{4})|(?P<perso>[CFGHJKLMNPRTVWXYZ0-9]{8,9}\d(?:D)?))(?![\w]|-\d)"
)
NUMBER_FIRST = re.compile(r"\d{1,5}(?: ?(?:bis|ter|quater|BIS|TER|[A-Za-z])(?![\w]))?,? ([^\W\d_]+\.?)")
NUMBER_STREET = re.compile(rf"\d{{1,5}} ?[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'’.-]*[ ]){{1,3}}(?i:{NUMBERED})\b\.?")
_PARTS_FR = r"(?:(?i:de la|de|du|des|la|le|les|et|en|au|aux|sur)[ ]|(?i:[dl])['’])*"
NUMBER_ROAD = re.compile(rf"\d{{1,5}}(?: ?(?i:bis|ter|quater|[A-Z]))?,? (?i:{ROAD_FR}) (?:{_PARTS_FR}[A-ZÀ-Þ][\w'’.-]*(?:[ -]{_PARTS_FR}[A-ZÀ-Þ][\w'’.-]*)*|[^\d,;\n|/]{{3,}})")
ROADS_FR = frozenset("rue avenue av. chemin impasse boulevard bd place allée quai route cours passage square sentier faubourg".split())
# Endings of German streets.
STREETS_DE = tuple("straße strasse str. weg allee gasse platz ring damm ufer steig chaussee graben".split())
NUMERO = tuple("n. nº n° no no.".split())
NUMBER = re.compile(r"(?<!\d)\d{1,5}(?!\d)")
STREET_NUMBER = re.compile(r"(?<![\w-])[A-ZÄÖÜ][\w-]*(?:[ -][A-ZÄÖÜ][\w-]*)?[ -]?(?i:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|chaussee|graben) ?(?:n[.º°o]{1,2} ?)?\d{1,4}(?: ?[a-z])?\b")
# Beginnings of Spanish streets.
STREETS_ES = tuple("calle |c/|avenida |avda|plaza |paseo |camino |carrera |ronda |travesía |callejón |via |vía ".split("|"))
ROAD_NUMBER = re.compile(rf"(?<![\w-])(?i:{ROAD_ES}) [^\d\n;|]{{2,}}?,? ?(?:n[.º°o]{{1,2}} ?)?\d{{1,4}}(?: ?[a-z])?\b")
INITIALS = re.compile(r"(?<![\w.])[A-ZÀ-Þ]\. ?(?:[A-ZÀ-Þ]\. ?)?(?=(?:" + PARTICLE + r"\s)?[A-ZÀ-Þ][\w'’-]+)")
LAST = re.compile(rf"(?:{PARTICLE}\s+)?([A-ZÀ-Þ][\w'’-]+)")
CAPITAL = r"[A-ZÀ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
NAME_BEFORE = re.compile(rf"({CAPITAL})[ \t]+$")
JOINT = re.compile(rf"[ \t]+(?:[A-ZÀ-Þ]\.[ \t]+)?(?:{PARTICLE}[ \t]+)?")
CAPITALISED = re.compile(CAPITAL)
REVERSED = re.compile(rf",[ \t]{{1,3}}({CAPITAL})(?![\d_@＠])(?:[ \t]([A-ZÀ-Þ]\.)(?= |,|$))?")
TITLES = frozenset("mr mrs ms miss mx dr prof sir mme mlle m mm monsieur madame herr herrn frau sr sra srta don doña señor señora".split())
# Closings of letters, and what stands between a name and a contact.
CLOSING = re.compile(r"(?:regards|sincerely|faithfully|wishes|thanks|cordialement|salutations|grüßen|grüsse|grüße|saludos?|atentamente)[,.!]?\s*$", re.I)
ALONE = re.compile(rf"\n[ \t]*({CAPITAL})[ \t]*(?=\r?\n|$)")
TITLED_BY = re.compile(rf"\w+\.?[ \t]+((?:{PARTICLE}[ \t]+)?({CAPITAL}))(?![\d_@＠])")
STREET = re.compile(rf"(?:{NUMBERED})\.?", re.I)
CONTACT = re.compile(r"[ \t]*[<(:,/|][ \t]*(?:[\w.+-]{1,64}@\w|\+?\(?\d[\d ().-]{6,}\d)")
LABELS = frozenset("tel telefon telephone telefono phone mobile mobil fax email mail courriel correo contact kontakt contacto call appelez durchwahl poste hotline".split())
WORDS_OF_NAME = 4
# Words that begin sentences before a place or a month, months, and what stands before a contact.
COMMON = frozenset(plain(w) for words in FUNCTION_WORDS.values() for w in words.split()) | frozenset(
    """in on at by for from between to as until since near within per en entre pour a dans des depuis vers selon chez para desde hasta segun hacia zwischen fur bis laut seit bei nach aus unter january february march april may june
    july august september october november december janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre januar februar marz juni juli oktober dezember""".split()
)
WORD = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, str, list[str]]


def _shape(value: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"[   ]", " ", value)))


def _around(text: str, start: int, end: int) -> list[str]:
    left = text[max(0, start - 32) : start]
    words = WORD.findall(left)
    out = [f"l1={words[-1].lower()}" if words else "l1=", f"l2={words[-2].lower()}" if len(words) > 1 else "l2="]
    near = left.rstrip(" \t(")[-1:]
    out.append(f"lc={near if not near.isalnum() else ('9' if near.isdigit() else 'A')}")
    after = text[end : end + 1]
    out.append(f"rc={after if not after.isalnum() else 'A'}")
    return out


def _emails(text: str) -> Iterator[Span]:
    signs = [m.span() for m in AT.finditer(text)]
    if " at " in text or " AT " in text or " at\t" in text or " AT\t" in text:
        signs += [m.span() for m in SPOKEN_AT.finditer(text)]
    for start, end in signs:
        sign = text[start:end]
        if sign[0] in "[({":  # one blank on either side belongs to it
            start -= text[start - 1 : start] in (" ", "\t")
            end += text[end : end + 1] in (" ", "\t")
        local = LOCAL.search(text, max(0, start - 64), start)
        host = HOST.match(text, end)
        if local and host and re.search(r"[^\W\d_]{2,}$", host.group()) and host.end() - local.start() <= MAX_SPAN:
            kind = "sign" if sign in "@＠" else "word"
            spelled = host.group().count(".") == 0
            yield local.start(), host.end(), "email", [f"at={kind}", f"at,spelled={kind},{spelled}"]


def _numbers(text: str) -> Iterator[Span]:
    for m in DIGITS.finditer(text):
        value = m.group().rstrip(" .-/(")
        digits = sum(c.isdigit() for c in value)
        if not 7 <= digits <= 16:
            continue
        start = m.start()
        if value.startswith("(") and ")" not in value:
            start, value = start + 1, value[1:]
        known = PHONE_SHAPES.match(value)
        whole = bool(known and (known.end() == len(value) or re.fullmatch(r" ?[a-z.]+ ?\d+", value[known.end() :], re.I)))
        lead = "+" if value[0] == "+" else "00" if value[:2] == "00" else value[0] if value[0] in "(01" else "9"
        kinds = ["".join(sorted({c if not c.isspace() else " " for c in value if not c.isdigit() and c not in "()+"}))[:4]]
        base = [f"lead={lead}", f"n={digits}", f"known={whole}", f"sep={kinds[0]}", f"lead,n={lead},{digits}", f"known,lead={whole},{lead}", f"shape={_shape(value)}"]
        yield start, start + len(value), "phone", base + _around(text, start, start + len(value))
        if known and not whole and sum(c.isdigit() for c in known.group()) >= 7:
            piece = known.group().rstrip(" .-")
            yield start, start + len(piece), "phone", [*base[:3], "part"] + _around(text, start, start + len(piece))
    for m in IDS.finditer(text):
        kind = m.lastgroup if m.lastgroup != "sep" else "ssn"
        value = m.group()
        if sum(c.isdigit() for c in value) < 6:
            continue
        yield m.start(), m.end(), "id_number", [f"kind={kind}", f"shape={_shape(value)}"] + _around(text, *m.span())


def _streets(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what could be an address: found by its number, then by the words before or after it."""
    for number in NUMBER.finditer(text):
        start, end = number.span()
        before = text[start - 1] if start else " "
        if before in " .°ºo" or before.isalpha():
            lead = text[max(0, start - 16) : start].rstrip().lower()
            if (lead.endswith(STREETS_DE) or (lead.endswith(NUMERO) and lead.rstrip("n.º°o").rstrip().endswith(STREETS_DE))) and end - start < 5:
                line = max(text.rfind("\n", 0, start) + 1, start - MAX_SPAN)
                found = next((x for x in STREET_NUMBER.finditer(text, line, end + 3) if x.start() < start < x.end()), None)
                if found:
                    yield *found.span(), "de"
        if before.isalnum() or before in "_.,/:-":
            continue
        m = NUMBER_FIRST.match(text, start)
        if not m:
            continue
        word = m.group(1)
        if word.rstrip(".").lower() in ROADS_FR or word.lower() in ROADS_FR:
            found = NUMBER_ROAD.match(text, start)
            if found:
                yield *found.span(), "fr"
                continue
        if word[0].isupper() or text[end : end + 2].strip(" ,").isalpha():
            found = NUMBER_STREET.match(text, start)
            if found:
                yield *found.span(), "en"
    low = text.lower()
    if any(w in low for w in STREETS_ES):
        for m in ROAD_NUMBER.finditer(text):
            yield *m.span(), "es"


def _addresses(text: str) -> Iterator[Span]:
    for start, end, kind in _streets(text):
        value = text[start:end]
        words = WORD.findall(value)
        lower = sum(w[0].islower() for w in words if w.lower() not in ("bis", "ter"))
        digits = len(re.match(r"\d+", value).group()) if kind in ("fr", "en") else len(re.search(r"\d+", value).group())
        yield start, end, "address", [f"road={kind}", f"lower={kind},{min(lower, 3) if kind == 'en' else 0}", f"road,digits={kind},{digits}", f"upper={value.isupper()}", f"words={kind},{min(len(words), 6)}"] + _around(text, start, end)


class Lexicon:
    """What is known of a word: the field's features of words.

    ``usual`` holds words that texts write in lower case, read from the vocabulary of a public
    tokenizer; names and places are mostly not among them.
    """

    def __init__(self, usual: frozenset[str] = frozenset()):
        self.usual, self._known = usual, {}

    def __getstate__(self):
        return self.usual

    def __setstate__(self, usual):
        self.__init__(usual)

    def __call__(self, word: str) -> tuple[bool, bool, bool, bool, bool, bool]:
        """Whether a word is a listed given name, ends like a surname, is a common word, a label of a contact, in capitals, usual in lower case."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            w = plain(word)
            found = (w in GIVEN or w.split("-")[0] in GIVEN, w.endswith(SURNAME), w in COMMON, w in LABELS, word.isupper() and len(word) > 1, word.lower() in self.usual or all(x in self.usual for x in word.lower().split("-")))
            self._known[word] = found
        return found


def usual_words(*vocabularies: str) -> frozenset[str]:
    """Words of at least three letters that a rank file holds in lower case as one token after a blank; none where the file is missing."""
    found = set()
    for path in filter(os.path.exists, vocabularies):
        for line in Path(path).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            if len(token) > 3 and token[0] == " " and token[1:].isalpha() and token.islower():
                found.add(token[1:])
    return frozenset(found)


def _capitalised(text: str, lexicon: Lexicon) -> Iterator[Span]:
    """Runs of capitalised words with initials and particles between them, single ones after a title, in a signature or before a contact, pairs about a comma, and words after initials."""

    def initialled(start: int) -> Iterator[Span]:
        """Initials and the word after them."""
        m = INITIALS.match(text, start)
        after = LAST.match(text, m.end()) if m else None
        if after:
            before = NAME_BEFORE.search(text, max(0, start - 24), start)
            follows = f"initial:follows={bool(before and not lexicon(before.group(1))[2])}"
            yield start, after.end(), "name", [*features(start, after.end(), "initial", [after.group(1)]), follows]

    def features(start: int, end: int, form: str, words: list[str]) -> list[str]:
        title = bool(TITLE.search(text, max(0, start - 12), start))
        kinds = [lexicon(w) for w in words]
        usual = sum(k[5] for k in kinds)
        listed, inner, known = kinds[0][0], any(k[0] for k in kinds[1:]), kinds[-1][1]
        before = text[max(0, start - 12) : start].rstrip(" \t*#|_\"'(-")
        opening = not before or before[-1] in ".!?:;\n"
        common = "label" if any(k[3] for k in kinds) else kinds[0][2]
        upper = sum(k[4] for k in kinds)
        case = "all" if upper == len(words) else "first" if kinds[0][4] and upper == 1 else "some" if upper else "none"
        after = text[end : end + 2].lstrip(" \t")[:1]
        follow = "9" if after.isdigit() else "end" if not after or after.isspace() else _follow(text, end)
        street = bool(STREET.fullmatch(words[-1]))
        return [
            f"form={form}", f"{form}:title={title}", f"{form}:listed={listed}", f"{form}:inner={inner}", f"{form}:family={known}", f"{form}:common={common}", f"{form}:case={case}", f"{form}:words={len(words)}", f"{form}:opening={opening}",
            f"{form}:title,words={title},{len(words)}", f"{form}:opening,title={opening},{title}", f"{form}:listed,family={listed},{known}", f"{form}:next={follow}", f"{form}:street={street}", f"{form}:usual={usual},{len(words)}", f"{form}:last={kinds[-1][5]},{kinds[-1][1]}", f"{form}:first={kinds[0][5]},{opening}", *(f"{form}:{f}" for f in _around(text, start, end)),
        ]

    run: list[tuple[int, int]] = []  # the words of the run so far
    last = -1
    for m in CAPITALISED.finditer(text):
        start, end = m.span()
        after = text[end : end + 1]
        if run and not ((start - last == 1 and text[last] in " \t") or (start - last < 24 and JOINT.fullmatch(text, last, start))):
            run = []
        last = end
        if after == ".":
            if end - start == 1:
                yield from initialled(start)
                if not run:
                    continue
                if text[end + 1 : end + 2] in (" ", "\t"):
                    last = run[-1][1]  # an initial stands between words
                    continue
        elif after.isdigit() or after in ("_", "@", "＠") or (after == "-" and text[end + 1 : end + 2].isdigit()):
            run = []
            continue
        if not run:
            before = text[start - 1] if start else " "
            if before.isalnum() or before in "_@.＠/'’-":
                continue
        word = m.group()
        run.append((start, end))
        if word.lower() in TITLES:
            lead = TITLED_BY.match(text, start)
            if lead and lead.group(2).lower() not in TITLES:
                yield *lead.span(1), "name", features(*lead.span(1), "single", [lead.group(2)])
            run = []
            continue
        if len(run) > 1 and end - start > 1:
            del run[:-WORDS_OF_NAME]
            part = [text[x:y] for x, y in run]
            for i in range(len(run) - 2, -1, -1):
                yield run[i][0], end, "name", features(run[i][0], end, "open", part[i:])
        if after in ("<", "(", ":", ",", "/", "|") or (after in (" ", "\t") and text[end + 1 : end + 2] in ("<", "(", ":", ",", "/", "|")):
            if CONTACT.match(text, end):
                yield start, end, "name", features(start, end, "contact", [word])
            if after == "," and end - start > 1:
                given = REVERSED.match(text, end)
                if given:
                    stop = given.end(2) if given.group(2) else given.end(1)
                    yield start, stop, "name", features(start, stop, "comma", [given.group(1), word])
    for m in ALONE.finditer(text):
        if CLOSING.search(text, max(0, m.start() - 20), m.start()):
            yield m.start(1), m.end(1), "name", features(m.start(1), m.end(1), "signed", [m.group(1)])


def _follow(text: str, end: int) -> str:
    m = re.match(r"\s+([^\W\d_]+)", text[end : end + 24])
    if not m:
        return text[end : end + 1].strip() or " "
    return "Cap" if m.group(1)[0].isupper() else "word"


def candidates(text: str, lexicon: Lexicon | None = None) -> list[Span]:
    """Possible entities with their features, ordered by start; of equal spans of one source the first, of two sources the features of both."""
    found: dict[tuple[int, int, str], list[str]] = {}
    for source in (_emails(text), _numbers(text), _addresses(text), _capitalised(text, lexicon or Lexicon())):
        own: dict[tuple[int, int, str], list[str]] = {}
        for start, end, kind, features in source:
            if end - start <= MAX_SPAN:
                own.setdefault((start, end, kind), features)
        for key, features in own.items():
            found[key] = found[key] + features if key in found else features
    return sorted(((s, e, k, f) for (s, e, k), f in found.items()), key=lambda c: (c[0], c[1], c[2]))


class Tagger:
    """Weights of the field, and its inference."""

    def __init__(self, weights: dict[str, float] | None = None, lexicon: Lexicon | None = None):
        self.weights, self.lexicon = weights or {}, lexicon or Lexicon()

    def score(self, span: Span) -> float:
        kind, get = span[2], self.weights.get
        return get(f"{kind}|", 0.0) + sum(get(f"{kind}|{f}", 0.0) for f in span[3])

    def link(self, before: Span | None, after: Span) -> float:
        return self.weights.get(f"{before[2]}>{after[2]}", 0.0) if before and after[0] - before[1] <= NEAR else 0.0

    def best(self, spans: list[Span]) -> list[Span]:
        """The segmentation of highest score; spans that touch may follow each other, none overlap."""
        if not spans:
            return []
        order = sorted(spans, key=lambda c: (c[1], c[0]))
        value, back, top = [], [], []  # top[i]: best state among the first i + 1, without a link
        for i, span in enumerate(order):
            base, source = 0.0, -1
            j = i - 1
            while j >= 0 and order[j][1] > span[0]:
                j -= 1
            while j >= 0 and span[0] - order[j][1] <= NEAR:
                linked = value[j] + self.link(order[j], span)
                if linked > base:
                    base, source = linked, j
                j -= 1
            if j >= 0 and value[top[j]] > base:  # none of these is linked to it
                base, source = value[top[j]], top[j]
            value.append(base + self.score(span))
            back.append(source)
            top.append(i if not top or value[i] > value[top[-1]] else top[-1])
        i, out = top[-1], []
        if value[i] <= 0:
            return []
        while i >= 0:
            out.append(order[i])
            i = back[i]
        return out[::-1]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        return [(s, e, k) for s, e, k, _ in self.best(candidates(text, self.lexicon))]


# Templates of the training sentences: {N}ame, {E}mail, {P}hone, {I}d, {A}ddress are entities, other slots are not.
POSITIVE = """Please contact {N} at {E} or {P}.|{N} will call back on {P}|Tel. {P}|Phone: {P}|Please call {P} if the {o} stops.|You can reach {N} on {P} while the office is closed.|T: {P} / {E}|Mr. {N} and Ms {N} attended.|
Dr {N} signed the {o}.|Write to {E}, copy to {E}.|From: {N} <{E}>, subject: {o}|Met {N} near the {o} today.|According to {N}, the {o} was late.|Kind regards,\n{N}|Kind regards,\n{N}\n{A}\n{P}|The parcel goes to {A} by May.|{N}, {A}, will thank you.|
My new address is {A}, in case the {o} needs it.|National insurance no. {I} is missing.|Passport {I} was shown at {c}.|social security number {I}, as keeper of the {o}|My ID is {I} and I live at {A}.|granted to Ms {N} ({I}) and to Mr. {N} ({I}).|The tenant at {A} reported a fault.|
Numéro de sécurité sociale {I}, titulaire M. {N}, dossier {r}.|Pièce d'identité {I} jointe ; contact : {E}.|Joindre {N} au {P} si besoin.|Mme {N} habite {A}.|D'après {N}, le rapport est prêt.|Le courrier part vers {A} demain.|Merci de rappeler {N} au {P}.|
Rückfragen an {N}, Telefon {P}, bis Montag.|Herr {N} wohnt {A}.|Bitte an {A} senden, Kopie an {E}.|Laut {N} ist alles bereit.|Ausweisnummer {I} liegt vor.|Escriba a {N} ({E}) antes de marzo.|Según {N}, todo sigue igual.|DNI {I}, titular {N}, teléfono {P}.|Envíe el paquete a {A} el lunes.|La Sra. {N} firma hoy.|
| {N} | {o} | {P} | {E} ||{"contact": "{N}", "mail": "{E}", "lot": {n}}|Emergency list: {N} {P} / {N} {P}|Deliveries: {A}, ring {P}.|Signed in {c} on behalf of the team: {N} (born in {c}, id card {I}).|Questions go to {N}, {E}, before week {n}.|Yesterday {N} and {N} met.|Cc {E}; please|{E}; {P}|{N} / {P}|[write](mailto:{E}) now|- {N} can be reached on {P}|contact {N} ({P})|{N}.|{N}|{P}|{A}""".replace("|\n", "|").split("|")
NEGATIVE = """Order no. {k} was paid.|Reference RFP-2024-{k} replaces order no. {d} {d} {n}.|Invoice 2024/06/{n}/{d} covers {d} units.|Meter {d}-{d}-{n} counted 1 250 000,00 units on {n}/{n}/2021.|It runs release 10.{n}.2.{n} with patch {k}.|Build hash 9f{d}c{d}e and serial ZK-{d}-{d} belong to it.|
Grid point 48.{d}, 2.{d} marks the {o}.|Follow @desk_{c} or read https://docs.{c}.example/guide/{n}.|Version {n}.{n}, May 2026.|The Harbour Lane depot and the Castle Hill yard share one {o}.|Chapter {n} of the Avenue plan and box {n} of {c}.|Costs in {c} rose by {n} percent in 2021.|Of {d} users in {c}, {d} still wait.|
{B} & {B} Partners signed under standard ISO 27001:2013.|{g} Bridge Logistics and {g} Valley Water closed it.|Item {r} links the {o} to {d} cases.|Le lot {n} coûte {d} EUR à {c}.|Zwischen {c} und {c} zählt man {d} Punkte.|Tracking code {r}-{d}, ticket {d}{d}.|In {c}, {d} sites of {c} changed on {n} May 2020.|Annexes: A, B, C|{d};{c};{d};{c}|Account {d}{d}{d}, batch {d}-{n}|the {g} Street school|Saint {g} Square is closed|ISBN 978-{n}-{d}-{d}-1|Room {n} at Station Road|{n} copies of the road survey|Lot {n} of {c} Road Survey costs {d}|{d} units at 12.50 each|{n} sites by the street|EUR {d} {d},00 due""".replace("|\n", "|").split("|")
# Templates of names that no list has ({S}urname alone) and of other capitalised words ({C}, after a common word {F}).
TITLED = """Dear Mr {S},\nthe {o} is due.|Mrs. {S} keeps the {o}.|Ask Dr {S} or Ms {S}.|Mme {S} répond lundi.|Frau {S} prüft es.|Herr {S} kommt morgen.|La Sra. {S} llega hoy.|Prof. {S} wrote to {E}.|{S} ({P}) keeps the {o}.|Telefon {P}, Fax ({P})|Kontakt, {E}|Mobile / {P}|Contact: {E}|Best regards,\n{S}""".split("|")
CAPITALS = """## {C} {C}\n\nThe {o} follows.|**{C} {C}**: {d} units|The {C} {C} keeps the {o}.|In {c}, the {C} {C} opened {d} sites.|{C} {C} Ltd won lot {n}.|{C} {c} and {c} the {o} moved.|{C} {c} zählt man {d} Punkte.|{C} {c}, {d} sites changed.|{F} {C}, the {o} moved.|\n\n{F} {c} and {c}, the {o} failed.|{o}. {F} {C} {n}, the {o} failed.|{F} {C} {n} moved.|{C} {r} links the {o} to {d} cases.|Der {C} prüft die {C} in {c}.|La {C} {C} ouvre en {C}.|{C} {C}\n\nThe {o} was late.|- {C} {C}: {n}|{C}, {c} and {c}|{c}, {c}, {C}|{C} {C} {C} of {c} {n}|see {C} {C} for the {o}|from {C} {c} to {c}|The {C} Lane {o} of {C} {C} Partners|at the {C} {C}.|{C} {C} Logistics signed it.|{C} {C} described the {o}.|{C} {C} is a {o}.|for {C} {c}, {n} sites|[{C} {C} {C}]|- {F} {c}, the {o} failed.|. {F} {c}, le {C} {n}|- {F} {c} and {c}, {d} sites|{F} {c}, die {o}|{F} {c} et {c}, le lot {n}|{o}. {F} {c}, {d} sites""".split("|")


# Templates of names and of other capitalised words among any words ({w}; {W} with a capital; {f} a common word).
FREE = """{w} {w} {N} {w} {w}.|{N} {w} {w} {w}.|{w} {f} {N} {f} {w}.|{W} {f} {w} {f} {N}.|{W}: {N}|{N}: {w} {w}.|{w}, {N}, {w} {w}|{f} {N} {f} {w}|{W} {N} {w} {f} {w}.|{W} {N},\n{w} {w}|{w} {w} {f} {N}, {w}|{w}.\n{N}\n|{N}, {N} {f} {N} {w} {w}|{w}. {N} {w} {f}|{W},\n{N}|I {w} {f} {N} {w}.|{N} {w} {w} {f} {w}|{w}. {N} {w} {f}|{f} {w} {f} {N} {w}|{W} {N} {f} {P} {w}|{w}. {W} {N} {f} {P}|{W} {f} {N}\n|{f} {w} {N} {w}""".split("|")
FREE_CAPITALS = """{w} {f} {W} {W} {w}.|{W} {W}|{W} {W} {W}|{f} {W} {W}|{f} {c} {W} {w}|{w} {W} {W} {f} {c}|{W} {W}: {w}|{W}, {W} {f} {W}|{f} {W} {W} {W} {w}|{W} {W} {w} {w}.|{w}.\n{W} {W}\n|- {W} {W}|{w} {f} {c} {W} {w}.|{F} {c} {w} {f} {W} {W}.|{W} {f} {W} {W}|{w} {c}, {c} {f} {c} {w}|{F} {W} {W} {w}.|{w}, {W} {W}, {w}|{F} {c}, {w} {f} {w}|{w}.\n\n{F} {c}, {f} {w} {w}|{F} {c}, {f} {w} {w}|- {F} {c}, {f} {w} {w}|{w}. {F} {c} {w} {f}|{w} {f} {W} {c} {w}|{W} {c} {w} {f}|{w}. {F} {c} {w}|- {F} {c} {f} {w}|{w} {W} {W} {w}""".split("|")


def _examples(count: int, seed: int = 11, outside: bool = False, usual: Sequence[str] = ()) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """Labelled sentences drawn from the templates; ``outside``: with names outside the list and more capitalised words; ``usual``: with words of a vocabulary about them."""
    r = random.Random(seed)
    usual = usual or "meter reading risk log budget line pilot site office report".split()
    syllables = "ba de fi go hu ka le mi no pu ra se ti vo wu xa ye zo bra cle dri fro gli kra ple tri".split()
    given, common = sorted(GIVEN), sorted(COMMON)

    def made(n: int = 2) -> str:
        return "".join(r.choice(syllables) for _ in range(n))

    def num(shape: str) -> str:
        return re.sub("9", lambda _: str(r.randrange(10)), shape)

    def family() -> str:
        out = (made() + r.choice(SURNAME)).capitalize()
        return out + "-" + (made() + r.choice(SURNAME)).capitalize() if r.random() < 0.15 else out

    def surname() -> str:
        return family() if r.random() < 0.5 else made(r.choice((2, 2, 3))).capitalize()

    def name() -> str:
        g, f, x = r.choice(given).capitalize(), family(), r.random()
        if outside and r.random() < 0.5:  # a surname of any ending, mostly after a given name outside the list
            g, f = g if r.random() < 0.3 else made(r.choice((2, 2, 3))).capitalize(), surname()
        if x < 0.55:
            return f"{g} {f}"
        if x < 0.63:
            return f"{g} {r.choice('ABDKLRS')}. {f}"
        if x < 0.71:
            return f"{g} {r.choice(['de', 'von', 'van der', 'di', 'El'])} {f}"
        if x < 0.8:
            return f"{r.choice('ABDKLRS')}. {f}"
        return f"{f}, {g}" if x < 0.9 else f"{f.upper()} {g}"

    def email() -> str:
        local = r.choice([f"{made()}.{made()}", f"{made()}{r.randrange(99)}", f"{made()}-{made(3)}", f"{made()}+{made()}", f"{made()}_{made()}"])
        host = r.choice([f"{made(3)}.example", f"{made()}.{made(3)}.test", f"{made(3)}.example.org"])
        form = r.random()
        if form < 0.6:
            out = f"{local}@{host}"
        else:
            at, dot = r.choice([(" AT ", " DOT "), (" (at) ", "."), (" [at] ", " [dot] "), ("＠", "."), (" (at) ", " (dot) ")])
            out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.1 and "＠" not in out else out

    def phone() -> str:
        return num(r.choice(["+44 7799 999999", "0799 999 9999", "(999) 999-9999", "999-999-9999", "+33 9 99 99 99 99", "+33 (0)6 99 99 99 99", "09 99 99 99 99", "06.99.99.99.99", "099/99999 999", "+49 30 99999 999", "0044 7799 999999", "1 999 999 9999", "+1 (999) 999-9999", "07999999999", "+49999999999", "(020) 7999 9999", "0699 99 9999", "999.999.9999", "+44 20 7999 9999", "07999 999 999", "+34 999 999 999", "+44 20 7999 9999 ext. 99"]))

    def identity() -> str:
        return num(r.choice(["QQ999999A", "QQ 99 99 99 B", "AB999999C", "999-99-9999", "999 99 9999", "2 99 04 99 999 999 99", "199079999999999", "XQ9999999", "QZ9999999", "99999999-" + r.choice("ABIOXT"), "99999999" + r.choice("ABIOXT")]))

    def address() -> str:
        w = made(2).capitalize()
        town, n = made(3).capitalize(), str(r.randrange(1, 500))
        x = r.random()
        if x < 0.45:
            kind = r.choice("Street St. Lane Road Rd Avenue Ave Close Way Blvd Drive Court Terrace".split())
            out = f"{n}{r.choice(['', '', 'A', 'b'])} {w} {r.choice(['', made().capitalize() + ' '])}{kind}"
        elif x < 0.7:
            out = f"{n}{r.choice(['', ' bis', ''])}{r.choice([',', ''])} {r.choice('rue avenue chemin impasse boulevard allée'.split())} {r.choice(['des', 'du', 'de la'])} {w}"
            return out + r.choice(["", f", {num('99999')} {town}"])
        elif x < 0.85:
            out = f"{w}{r.choice(['straße', 'weg', 'allee', 'str.', 'gasse'])} {n}"
        else:
            out = f"Calle {r.choice(['del', 'de la', 'de los'])} {w}, {n}"
        return out

    slots = {"N": (name, "name"), "S": (surname, "name"), "E": (email, "email"), "P": (phone, "phone"), "I": (identity, "id_number"), "A": (address, "address")}
    fill = {
        "o": lambda: r.choice(["meter reading", "risk log", "budget line", "pilot site"]), "c": lambda: (made(3) if r.random() < 0.6 else made() + r.choice(SURNAME)).capitalize(), "n": lambda: str(r.randrange(1, 60)), "d": lambda: num("9999"),
        "k": lambda: num("555-9999") if r.random() < 0.5 else num("999-999"), "r": lambda: f"{r.choice('ABKZ')}{r.choice('CDPT')}-{r.randrange(100, 9999)}", "B": lambda: family(), "g": lambda: r.choice(given).capitalize(), "F": lambda: r.choice(common).capitalize(), "C": lambda: (r.choice(usual) if r.random() < 0.92 else made(r.choice((2, 3))) + r.choice(["", r.choice(SURNAME)])).capitalize(),
        "w": lambda: r.choice(usual), "W": lambda: r.choice(usual).capitalize(), "f": lambda: r.choice(common),
    }
    for i in range(count):
        template = r.choice((POSITIVE, NEGATIVE, POSITIVE + TITLED + FREE, NEGATIVE + CAPITALS + FREE_CAPITALS)[1 - i % 2 + 2 * outside])
        text, truth = "", set()
        for part in re.split(r"(\{\w\})", template):
            key = part[1:-1] if re.fullmatch(r"\{\w\}", part) else ""
            if key in slots:
                value = slots[key][0]()
                truth.add((len(text), slots[key][1]))
                text += value
            else:
                text += fill[key]() if key in fill else part
        yield text if truth or not outside or r.random() > 0.15 else text.upper(), truth


def train(count: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 11, vocabularies: Sequence[str] = VOCABULARIES) -> Tagger:
    """Weights that maximise the likelihood of the labelled sentences (Adagrad, L2); the driver alone reads the vocabularies."""
    data = []
    lexicon = Lexicon(usual_words(*vocabularies))
    words = sorted(lexicon.usual - GIVEN - COMMON)
    for text, truth in chain(_examples(count, seed), _examples(2 * count, seed, outside=True, usual=words)):
        spans = sorted(candidates(text, lexicon), key=lambda c: (c[1], c[0]))
        gold = []
        for start, kind in sorted(truth):
            same = [i for i, c in enumerate(spans) if c[0] == start and c[2] == kind]
            if same:
                gold.append(max(same, key=lambda i: spans[i][1]))
        gold = [g for k, g in enumerate(gold) if k == 0 or spans[g][0] >= spans[gold[k - 1]][1]]
        if spans:
            data.append((spans, gold))
    tagger, squares = Tagger(lexicon=lexicon), defaultdict(float)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for spans, gold in data:
            gradient = _gradient(tagger, spans, gold)
            for f, g in gradient.items():
                if abs(g) > 1e-6:
                    g -= 1e-3 * tagger.weights.get(f, 0.0)
                    squares[f] += g * g
                    tagger.weights[f] = tagger.weights.get(f, 0.0) + RATE * g / math.sqrt(squares[f] + 1e-8)
    return tagger


def _gradient(tagger: Tagger, order: list[Span], gold: list[int]) -> dict[str, float]:
    """Gradient of the log-likelihood: features of the gold segmentation less their expectation."""
    n = len(order)
    score = [tagger.score(s) for s in order]
    before = [[j for j in range(i) if order[j][1] <= order[i][0]] for i in range(n)]
    forward = [0.0] * n  # log-sum of segmentations that end with i
    for i in range(n):
        forward[i] = score[i] + _logsum([0.0] + [forward[j] + tagger.link(order[j], order[i]) for j in before[i]])
    total = _logsum([0.0, *forward])
    backward = [0.0] * n
    for i in reversed(range(n)):
        backward[i] = _logsum([0.0] + [score[k] + tagger.link(order[i], order[k]) + backward[k] for k in range(i + 1, n) if i in before[k]])
    out: dict[str, float] = defaultdict(float)
    for i, span in enumerate(order):
        p = (1.0 if i in gold else 0.0) - math.exp(forward[i] + backward[i] - total)
        out[f"{span[2]}|"] += p
        for f in span[3]:
            out[f"{span[2]}|{f}"] += p
        for j in before[i]:
            if span[0] - order[j][1] <= NEAR:
                follows = i in gold and j in gold and gold.index(i) == gold.index(j) + 1
                pair = math.exp(forward[j] + tagger.link(order[j], span) + score[i] + backward[i] - total)
                out[f"{order[j][2]}>{span[2]}"] += float(follows) - pair
    return out


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each finding."""
    for start, end, kind in sorted(found, reverse=True):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def findings(df: DataFrame, key: str, text: str, part: str | None = None, tagger: Tagger | None = None) -> DataFrame:
    """(part, key, pii_type, start_pos, end_pos, value), positions in code points from 0.

    Null texts have no row; a repeated (part, key, text) counts once.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger or train())
    source = df.select((F.col(part) if part else F.lit("")).cast("string").alias("part"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text is not null")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, k, kind, s, e, t[s:e]) for p, k, t in zip(pdf["part"], pdf["key"], pdf["text"], strict=True) for s, e, kind in shared.value.find(t)]
            yield pd.DataFrame(out, columns=["part", "key", "pii_type", "start_pos", "end_pos", "value"])

    return source.mapInPandas(find, "part string, key string, pii_type string, start_pos long, end_pos long, value string").distinct()


def redacted(df: DataFrame, text: str, tagger: Tagger | None = None) -> DataFrame:
    """``df`` with placeholders in its text column; other columns, null texts and repeated rows stay."""
    shared = df.sparkSession.sparkContext.broadcast(tagger or train())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, shared.value.find(t)))

    return df.withColumn(text, clean(F.col(text)))
