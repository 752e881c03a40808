"""Personal information in free text: where it stands, and the text with placeholders.

A chain of transducers turns a text into a plain one and remembers for each of its characters where
it came from; detectors read the plain text, and their spans are mapped back."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Cuts
from .given_names import PARTICLES, TITLES, known_given, plain
from .lookalikes import INVISIBLE, tables

# ---------------------------------------------------------------- transducers

UNSEEN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), INVISIBLE))
MARKS = re.compile("[\u0300-\u036f\u3099\u309a]")

# Digits as words in English, Spanish, German, French and Portuguese.
DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one uno eins un um", "2": "two dos zwei deux dois", "3": "three tres drei trois três",
    "4": "four cuatro vier quatre quatro", "5": "five cinco fünf cinq", "6": "six seis sechs six", "7": "seven siete sieben sept sete",
    "8": "eight ocho acht huit oito", "9": "nine nueve neun neuf nove",
}
# How "at" and "dot" are written out.
AT_WORDS, DOT_WORDS = "at|arroba|ät|chiocciola|собака", "dot|punto|punkt|ponto|point|точка"

WORD_DIGIT = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_number = "|".join(sorted(WORD_DIGIT, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)\b(?:(?:double|triple)\s+)?(?:{_number})(?:[\s,.-]+(?:(?:double|triple)\s+)?(?:{_number})){{5,}}\b")
SPELLED_ONE = re.compile(rf"(?i)(?:(double|triple)\s+)?({_number})\b")
AT_HINTS, DOT_HINTS, BRACKET = frozenset(f"{AT_WORDS}|{DOT_WORDS}".split("|")), frozenset(DOT_WORDS.split("|")), re.compile(r"[\[({<]")
HIDDEN_AT = re.compile(rf"(?i)\s*[\[({{<]\s*(?:{AT_WORDS})\s*[\])}}>]\s*|(?<=\w)\s+(?:{AT_WORDS})\s+(?=[\w-]+\s+(?:{DOT_WORDS})\s)")
HIDDEN_DOT = re.compile(rf"(?i)\s*[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*|(?<=\w)\s+(?:{DOT_WORDS})\s+(?=\w)")


class Plain:
    """A plain text, and for each of its characters where what it stands for begins and ends in the source (None: the same place)."""

    __slots__ = ("text", "begin", "end")

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text, self.begin, self.end = text, begin, end

    def source(self, i: int) -> int:
        return i if self.begin is None else self.begin[i]

    def source_end(self, i: int) -> int:
        """Where the source of the characters before offset ``i`` ends."""
        return i if self.end is None else self.end[i - 1]

    def replaced(self, spans: list[tuple[int, int, str]]) -> Plain:
        """The transducer step: each span becomes a string, all of whose characters stand for the whole span."""
        begin = self.begin or list(range(len(self.text)))
        end = self.end or list(range(1, len(self.text) + 1))
        text, b, e, last = [], [], [], 0
        for x, y, to in spans:
            text += [self.text[last:x], to]
            b += begin[last:x] + [begin[x]] * len(to)
            e += end[last:x] + [end[y - 1]] * len(to)
            last = y
        text.append(self.text[last:])
        return Plain("".join(text), b + begin[last:], e + end[last:])


TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WORD = re.compile(r"[^\W\d_]+")
DOMAIN_PART = re.compile(r"[\w-]+(?:\.[\w-]+)*")
ACCENTED = re.compile("[^\u0300-\u036f\u3099\u309a][\u0300-\u036f\u3099\u309a]+")


@lru_cache(1)
def _letters() -> tuple[dict, dict, re.Pattern, re.Pattern, re.Pattern]:
    one, _, alike = tables()
    width = str.maketrans(one)
    width.update({ord(c): " " for c in "\u2028\u2029\t"})
    shape = str.maketrans(alike)
    own = "".join(c for c in map(chr, range(0x370, 0x590)) if c.isalpha() and c not in alike)
    # the signs of East Asian text are as telling in their wide form
    wide = "".join(re.escape(chr(c)) for c in width if c < 0x10000 and chr(c) not in "，！？：；、。")
    return width, shape, re.compile(f"[{own}]"), re.compile(f"[{''.join(alike)}]"), re.compile(f"[{wide}]|[\U0001d400-\U0001d7ff]")


def _latin_shape(word: str, shape: dict) -> str:
    return word.translate(shape) if re.search("[A-Za-z]", word) else word


def plain_letters(text: str) -> Plain:
    """Widths and blanks in their plain form, invisible characters gone, accents composed, and look-alike letters of
    other scripts as Latin ones; in a text that is of such a script only inside words with Latin letters."""
    p = Plain(text)
    if text.isascii():
        return p
    width, shape, own, alike, wide = _letters()
    if wide.search(text):
        p.text = text.translate(width)
    if UNSEEN.search(p.text):
        p = p.replaced([(m.start(), m.end(), "") for m in UNSEEN.finditer(p.text)])
    if MARKS.search(p.text):
        p = p.replaced([(m.start(), m.end(), unicodedata.normalize("NFC", m[0])) for m in ACCENTED.finditer(p.text)])
    if alike.search(p.text):
        if not own.search(p.text):
            p.text = p.text.translate(shape)
        elif re.search("[A-Za-z]", p.text):
            p.text = WORD.sub(lambda m: _latin_shape(m[0], shape), p.text)
    return p


def plain_text(text: str) -> tuple[Plain, list[str]]:
    """Plain letters, then spelled digits as digits and written-out "at" and "dot" as signs; with it the words in
    lower case, by which the detectors tell what need not be looked for."""
    p = plain_letters(text)
    words = TOKEN.findall(p.text.lower())
    if sum(map(WORD_DIGIT.__contains__, words)) >= 6:
        spans = []
        for m in SPELLED.finditer(p.text):
            digits = "".join(WORD_DIGIT[x[2].lower()] * {"double": 2, "triple": 3}.get((x[1] or "").lower(), 1) for x in SPELLED_ONE.finditer(m[0]))
            spans.append((m.start(), m.end(), digits))
        p = p.replaced(spans)
    if not AT_HINTS.isdisjoint(words) and (BRACKET.search(p.text) or not DOT_HINTS.isdisjoint(words)):
        p = p.replaced([(m.start(), m.end(), "@") for m in HIDDEN_AT.finditer(p.text)])
        spans = []
        for a in re.finditer("@", p.text):  # only dots that continue a domain
            part = DOMAIN_PART.match(p.text, a.end())
            while part and (d := HIDDEN_DOT.match(p.text, part.end())):
                spans.append((d.start(), d.end(), "."))
                part = DOMAIN_PART.match(p.text, d.end())
        if spans:
            p = p.replaced(sorted(set(spans)))
    return p, words


# ------------------------------------------------------------------ detectors

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+")

_edge, _end = r"(?<![\w@#.,/+-])(?<!\d[ ])", r"(?![\w@]|[-./]\d)"
ID_NUMBER = re.compile(
    rf"(?i)(?<![\w@#+-])(?<!\d[./])(?:\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}|\d{{3}}([ -])\d{{2}}\1\d{{4}}|[XYZ]-?\d{{7}}-?[A-Z]|\d{{8}}-?[A-Z]"
    rf"|[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]|[A-Z]\d{{8}}|[A-Z]{{2}}\d{{7}}){_end}"
)
_group = r"(?:[ .\-/]?(?:\(\d{1,4}\)|\d{1,8}))"
PHONE = re.compile(
    rf"(?<![\w@#])(?<![\d][./-])(?:\+ ?\d{{1,3}}{_group}{{1,7}}|00\d{{1,3}}{_group}{{1,7}}|(?:1[-. ]?)?\(\d{{3}}\) ?\d{{3}}[-. ]?\d{{4}}"
    rf"|\(0\d{{1,4}}\)[ ]?\d{{2,8}}(?:[ -]\d{{2,6}}){{0,2}}|0\d{{2,5}}(?:[ /\-.]\d{{2,8}}){{1,4}}|0\d{{8,11}}"
    rf"|(?:1[-. ])?[2-9]\d{{2}}([-. ])[2-9]\d{{2}}\1\d{{4}}|[2-9]\d{{2}}[2-9]\d{{6}}){_end}"
)
DIGIT = re.compile(r"\d")
# a version or build named by its day is no passport, and ten bare digits after such a word are no phone
DATED = re.compile(r"[vbr](?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])")
BARE_TEN = re.compile(r"[2-9]\d{9}")
# Words before a number that counts or names something else than a phone.
COUNTED = frozenset("ticket tickets order tracking ref reference case invoice receipt build item isbn sku serial parcel account log run window commit".split())
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def is_account(text: str) -> bool:
    """Whether a bank account number in international form has right check digits."""
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def is_phone(text: str, a: int, b: int) -> bool:
    if not BARE_TEN.fullmatch(text, a, b):
        return True
    before = re.findall(r"[^\W\d_]+", text[max(0, a - 40):a])[-2:]
    return COUNTED.isdisjoint(w.lower() for w in before)
HAS_NUMBER = re.compile(r"\d(?:[^\d\n]{0,3}\d){5}")

# Kinds of streets, where a lower-case word is telling and where it needs a capital.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Crescent|Cres|Boulevard|Blvd|Terrace|Drive|Court|Square|Mews|Parkway|Highway|Hwy"
STREETS_CAPITAL = "Way|Place|Pl|Row|Gardens|Hill|Dr|Ct|Sq"
FULL_KINDS = frozenset("Street Road Avenue Lane Close Crescent Boulevard Terrace Drive Court Square Mews Parkway Highway Way Place Row Gardens Hill".split())
# Words that may follow an address directly; another word makes the street part of a name.
AFTER_ADDRESS = set("""
with by around near at in on from for to before after until since and or but is was are were tomorrow today yesterday tonight now then
please if when where while not opposite behind next about because so as that which this last every again instead soon later here there
too also only still flat apt apartment unit suite floor two between during
por para en con y o antes después mañana ayer hoy a desde hasta que cuando si
em com e ou depois amanhã ontem hoje até quando se
vers pour à en et ou avant après demain hier chez par avec jusqu depuis quand si
um am im mit und oder vor nach morgen gestern heute bis zurück wenn ab bei zum zur aus
""".split())
# Words that do not belong to the name of an English street.
NOT_STREET = set("of to the in by at a an and or for with from is was are on my your our we i it this that there than seats coins times".split())
_w = r"[^\W\d_][\w'’-]*"
ENGLISH = re.compile(rf"(?i)(?<![\w.,/@#-])(?<!\d[ ])\d{{1,5}}[a-z]?,? ((?:{_w} ){{1,3}})({STREETS}|{STREETS_CAPITAL})\b\.?")
GERMAN = re.compile(
    r"(?<![\w-])(?:(?:[A-ZÄÖÜ][\w-]+ )?(?:Stra(?:ß|ss)e|Weg|Platz|Gasse|Allee|Damm|Ufer|STRASSE|WEG|PLATZ|GASSE|ALLEE)|"
    r"[^\W\d_][\w-]*(?:(?i:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|damm|ufer|ring|steig)))\s?(?:Nr\.? ?)?\d{1,4}\s?[a-zA-Z]?(?![\w@]|[-./]\d)"
)
# Compounds that end like a street but name something else that is numbered.
NOT_GERMAN = frozenset("boxring ehering schlüsselring parkplatz sitzplatz arbeitsplatz stellplatz stehplatz tabellenplatz liegeplatz bauplatz umweg heimweg rückweg hinweg ausweg schulweg schleichweg".split())
# Endings of nouns that places are named by; the noun alone is no street.
PLACE_ENDS = ("berg bach feld felde hof markt tor park wald see graben garten gärten anger brunnen hang rain wall wiese wiesen kirche kirchhof mühle bahnhof bogen winkel acker heide tal sand stein "
              "eck linden eichen buchen birken weiden tannen").split()
GERMAN_PLACE = re.compile(r"(?i)(?<![\w-])(am|im|an der|an den|in der|auf dem|auf der|zum|zur|unter den|hinter der) ([^\W\d_][\w-]{3,}) \d{1,4}[a-z]?(?=[,.;!?)]|\s|$)(?![-./]\d)")
POSTCODE = re.compile(r",? ?\d{5}\b")


def german_places(text: str) -> Iterator[tuple[int, int]]:
    """Streets named by where they lie, which only differ from other numbered things by the noun, by a capital inside a sentence, or
    by a postcode behind."""
    for m in GERMAN_PLACE.finditer(text):
        word = m[2].lower()
        inside = m[1][0].isupper() and m[2][0].isupper() and text[:m.start()].rstrip()[-1:] not in ("", ".", "!", "?", ":", "\n")
        if inside or POSTCODE.match(text, m.end()) or any(word.endswith(e) and word != e for e in PLACE_ENDS):
            yield m.start(), m.end()


_link = r"(?:de la|de las|de los|del|de|da|do|das|dos|della|di)"
ROMANCE = re.compile(
    rf"(?i)(?<![\w-])(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|carretera|ronda|rua|travessa|praça|largo|estrada|alameda|via|viale|piazza|corso)(?:(?<=[./]) ?| )"
    rf"(?:{_link} )?{_w}(?: (?:{_link} )?{_w}){{0,3}}?,? ?(?:n\.? ?º|nº|núm\.?|n°|no\.)? ?\d{{1,5}}(?![\w@]|[-./]\d)"
)
FRENCH = re.compile(
    rf"(?i)(?<![\w.,/@#-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|av\.|impasse|place|chemin|boulevard|bd|allée|quai|cours|passage|route|ruelle|square) "
    rf"(?:(?:de la|de l['’]|des|du|de|d['’]|le|la|les) ?)?{_w}"
)
RUSSIAN = re.compile(r"(?i)(?<![\w-])(?:ул\.|улица|проспект|пр-т|переулок|пер\.|площадь|бульвар|наб\.|шоссе) ?[\w-]+(?: [\w-]+)?,? ?(?:д\.|дом)? ?\d{1,4}\w?(?![\w@])")
CJK = re.compile(r"[\u4e00-\u9fff]{1,8}(?:路|街|大道|巷|弄)\d{1,5}(?:号|號)|\d{1,3}丁目\d{1,3}(?:番地?)?(?:\d{1,3}号)?")
STREET_WORDS = frozenset(
    f"{STREETS}|{STREETS_CAPITAL}".lower().split("|")
    + "am im zum zur hinter".split()
    + "calle c avenida avda av plaza paseo camino carrera carretera ronda rua travessa praça largo estrada alameda via viale piazza corso".split()
    + "rue impasse place chemin boulevard bd allée quai cours passage route ruelle square ул улица проспект пр переулок пер площадь бульвар наб шоссе".split()
)
BESIDE, ARTICLES = frozenset("an in auf unter".split()), frozenset("den der dem".split())
STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "damm", "ufer", "ring", "steig")
CJK_STREET = re.compile("[路街道巷弄丁]")


def may_be_address(text: str, words: list[str]) -> bool:
    return not STREET_WORDS.isdisjoint(words) or not BESIDE.isdisjoint(words) and not ARTICLES.isdisjoint(words) or any(w.endswith(STREET_ENDS) for w in words) or bool(CJK_STREET.search(text))


# Kinds of streets in French, Italian, Spanish and Portuguese that are common words as well; their name needs a capital.
UNSURE = frozenset("cours place passage route quai square ruelle via viale corso largo".split())
# Nouns that make a street part of an organisation's name.
NOT_TOWNS = frozenset("""bakery foundation hospital school university college clinic laboratories robotics engineering freight association society club choir band theatre
cinema museum library church hotel restaurant cafe café bar pub shop store market festival project team council committee posters press records studio studios gallery brothers company""".split())


def certain(m: re.Match) -> bool:
    words = re.findall(r"[^\W\d_][\w'’-]*", m[0])
    kind = next((i for i, w in enumerate(words) if w.lower() in UNSURE), None)
    if kind is None:
        return True
    named = next((w for w in words[kind + 1:] if not re.fullmatch(r"(?i)de|la|las|los|del|da|do|das|dos|della|di|des|du|le|les|n|º|nº|no", w)), "")
    # "via" is as common between a verb and a name
    return named[:1].isupper() and (words[kind].lower() != "via" or words[kind][0].isupper())


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in ENGLISH.finditer(text):
        words, kind = m[1].split(), m[2]
        if any(w.lower() in NOT_STREET for w in words):
            continue
        lower = kind.islower()
        if lower and kind.capitalize() in STREETS_CAPITAL.split("|") or not lower and words[-1].islower():
            continue
        ended = m[0].endswith(".") and kind.capitalize() in FULL_KINDS  # by a sentence's point
        after = None if ended else re.compile(rf" ({_w})").match(text, m.end())
        if after and after[1].lower() not in AFTER_ADDRESS and re.match(r"[A-Za-zÀ-ÿ]", after[1]):
            # a capital begins a sentence after an abbreviated kind with its point, or a town
            town = after[1][0].isupper() and not after[1].isupper() and not lower and after[1].lower() not in NOT_TOWNS and not re.compile(r" [A-Z]").match(text, after.end())
            if not (m[0].endswith(".") and after[1][:1].isupper() or town):
                continue
        yield m.start(), m.end() - ended
    for p in (FRENCH, ROMANCE, GERMAN, RUSSIAN, CJK):
        for m in p.finditer(text):
            if p is GERMAN and re.split(r"[\s\d]", m[0].lower())[0] in NOT_GERMAN or p in (FRENCH, ROMANCE) and not certain(m):
                continue
            yield m.start(), m.end()
    yield from german_places(text)


_title = "|".join(TITLES)
_family = rf"(?:(?:(?:{'|'.join(PARTICLES)})[ -])*[^\W\d_][^\W_]+(?:-[^\W\d_][^\W_]+)*)"
FAMILY_AFTER = re.compile(rf"(?i) (?:[^\W\d_]\.? )?({_family})")
FAMILY_WORD = re.compile(rf"(?i){_family}")


def family_before(text: str, at: int) -> int | None:
    """Where a family name begins that ends, with a comma, before offset ``at``, however long it is."""
    end = at - 1 if at and text[at - 1] == " " else at
    if not end or text[end - 1] != ",":
        return None
    start = end = end - 1
    while start and (text[start - 1].isalpha() or text[start - 1] in "-'’"):
        start -= 1
    while (x := text.rfind(" ", 0, max(0, start - 1))) + 1 < start and start and text[start - 1] == " " and text[x + 1:start - 1].lower() in PARTICLES:
        start = x + 1
    m = FAMILY_WORD.fullmatch(text, start, end)
    return m.start() if m else None


LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ſ]")
_plain = lru_cache(100_000)(plain)


def names(text: str, given: frozenset[str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, word, standing): a given and a family name, or with an end of -1 only what stands beside a given
    name. standing tells of the deciding word whether it has a capital (U) among mixed case, is in lower case (L) after
    a given name with a capital, or whether the case tells nothing (?)."""
    last = -1
    for m in TOKEN.finditer(text):
        if m.start() < last or len(m[0]) < 2 or _plain(m[0]) not in given:
            continue
        if m.start() and text[m.start() - 1] in "@._+-/" or text[m.end():m.end() + 1] in ("@", "_", "/"):
            continue
        if any(a <= m.start() < b for a, b in taken):
            continue
        word = m[0]
        cased = word[0].isupper() and not word.isupper()
        after = FAMILY_AFTER.match(text, m.end())
        if after and not LATIN.match(after[1]):
            after = None
        first = family_before(text, m.start())
        if first is not None and (not LATIN.match(text, first) or first and text[first - 1] in "@._+"):
            first = None
        head = lambda s: re.split(r"[ -]", s)[-1]
        if first is not None and (not after or not (cased and head(after[1])[0].isupper())):
            w = head(text[first:m.start()].rstrip(", "))
            while (x := re.match(rf"(?i)(?:{_title})\.? ", text[first:m.start()])):
                first += x.end()
            end = m.end()
            if x := re.compile(r" [^\W\d_]\.(?!\w)").match(text, end):
                end = x.end()
            standing = ("U" if w[0].isupper() else "L") if cased else "?"
            # a capital at the start of a sentence says little
            opening = not text[:first].strip() or text[:first].rstrip()[-1] in ".!?:\n。！？"
            yield first, end if standing != "L" else -1, plain(w), "?" if standing == "U" and opening else standing
            last = end
        elif after:
            w = head(after[1])
            if plain(w) in TITLES:
                continue
            standing = ("U" if w[0].isupper() else "L") if cased else "?"
            yield m.start(), after.end() if standing != "L" else -1, plain(w), standing
            if standing != "L":
                last = after.end()


def find(text: str, given: frozenset[str]) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, word, standing) in source offsets; word and standing only of names."""
    if not text:
        return []
    p, words = plain_text(text)
    t, out, taken = p.text, [], []

    def take(pattern: re.Pattern, kind: str, least: int = 0, spans: Iterator[tuple[int, int]] | None = None) -> None:
        for a, b in spans or ((m.start(), m.end()) for m in pattern.finditer(t)):
            if (not least or least <= sum(c.isdigit() for c in t[a:b]) <= 16) and not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                out.append((p.source(a), p.source_end(b), kind, "", ""))

    if "@" in t:
        take(EMAIL, "email")
    if DIGIT.search(t):
        if HAS_NUMBER.search(t):
            taken += [m.span() for m in ACCOUNT.finditer(t) if is_account(m[0])]  # neither an identity number nor a phone
            take(ID_NUMBER, "id_number", 0, (m.span() for m in ID_NUMBER.finditer(t) if not DATED.fullmatch(m[0])))
            take(PHONE, "phone", 8, (m.span() for m in PHONE.finditer(t) if is_phone(t, *m.span())))
        if may_be_address(t, words):
            take(ENGLISH, "address", 0, addresses(t))
    if any(map(given.__contains__, map(_plain, words))):
        for a, b, w, s in names(t, given, taken):
            out.append((p.source(a), p.source_end(b) if b > 0 else -1, "name", w, s))
    return out


# ------------------------------------------------------------------ operators

FOUND = "src string, row_no long, start_pos long, end_pos long, pii_type string, word string, standing string"


def learned_given(nodes: DataFrame, families: int = 4, share: float = 1 / 20_000) -> frozenset[str]:
    """Given names: those listed, and words that stand first in the two-word names of persons with at least ``families`` different last
    words. The model goes to every task; it is bounded as a word needs the share ``share`` of all such names, which at most 1 / ``share``
    words can have, whatever the number of names."""
    words = F.split(F.trim("name"), " ")
    people = (
        nodes.where((F.col("node_type") == "Person") & (F.size(words) == 2)).select(words[0].alias("g"), words[1].alias("f"))
        .where(F.col("g").rlike(r"^\p{Lu}[\p{L}'’-]+$") & ~F.col("g").rlike(r"^\p{Lu}{3,}$"))
    )
    least = share * people.count()
    rows = people.groupBy("g").agg(F.count_distinct("f").alias("n"), F.count(F.lit(1)).alias("m")).where((F.col("n") >= families) & (F.col("m") >= least))
    return frozenset(plain(r.g) for r in rows.collect()) | known_given()


def find_pii(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    """(src, row_no, start_pos, end_pos, pii_type), one row per occurrence, from (src, row_no, text).

    Types are email, phone, id_number, address and name; offsets count code points of the source. Whether a word beside
    a given name is a family name is clear by its capital; where the whole text is in one case, the corpus decides: the
    words beside given names are counted over all texts, and one that stands there in lower case more often than
    with a capital is no family name. Each text is read once. Null and empty texts hold nothing."""
    cuts = Cuts(texts.sparkSession, "pii")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [("src", pa.string()), ("row_no", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()),
                  ("pii_type", pa.string()), ("word", pa.string()), ("standing", pa.string())]
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            seen: dict[tuple[str, str], int] = {}
            for s, n, text in zip(*(batch.column(c).to_pylist() for c in ("src", "row_no", "text")), strict=True):
                for a, b, kind, w, standing in find(text, given):
                    if kind == "name" and standing != "?":
                        seen[w, standing] = seen.get((w, standing), 0) + 1
                    if b >= 0:
                        for col, v in zip(cols, (s, n, a, b, kind, w, standing), strict=True):
                            col.append(v)
            for (w, standing), n in seen.items():  # counts of the batch: how often, in start_pos
                for col, v in zip(cols, (None, None, n, None, "seen", w, standing), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    found = cuts.cut(texts.select("src", "row_no", "text").mapInArrow(run, FOUND))
    open_ = (F.col("pii_type") == "name") & (F.col("standing") == "?")
    common = (
        found.where("pii_type = 'seen'").groupBy("word")
        .agg(F.sum(F.when(F.col("standing") == "L", F.col("start_pos")).otherwise(-F.col("start_pos"))).alias("n"))
        .where("n > 0").select("word")
    )
    sure = found.where((F.col("pii_type") != "seen") & ~open_)
    return sure.unionByName(found.where(open_).join(common, "word", "left_anti").select(*found.columns)).drop("word", "standing")


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(src, row_no, text) with each occurrence replaced by its type in brackets, as [EMAIL]; the rest of
    the text stays as it is. Built from the right with SQL functions, no text leaves the JVM."""
    spans = found.groupBy("src", "row_no").agg(
        F.reverse(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_type")))).alias("__spans"))
    cut = F.aggregate(
        "__spans", F.col("text"),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start_pos"].cast("int")), F.lit("["), F.upper(s["pii_type"]), F.lit("]"),
                              F.substring(t, (s["end_pos"] + 1).cast("int"), F.length(t))))
    return texts.join(spans, ["src", "row_no"], "left").select(
        "src", "row_no", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut).alias("text"))


def texts_of(messages: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """(src, row_no, text) and the columns ``more`` of all message and edge rows."""
    rows = lambda df, src, key, text: df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_no"), F.col(text).alias("text"), *more)
    return rows(messages, "message", "id", "text").unionByName(rows(edges, "edge", "edge_no", "edge_text"))
