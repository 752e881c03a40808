"""Characters that show alike: tables for one consistent form, and the DuckDB SQL over them.

The compatibility forms come from the Unicode data by rule; only look-alikes are listed."""
from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts and symbol blocks with the shape of a Latin letter.
LOOKALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ",
    "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟ", "N": "Νꓠ",
    "O": "ΟОՕⲞꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ", "U": "Սꓴ",
    "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօⲟᴏ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хχ",
    "y": "уγү", "z": "ᴢ",
    "Æ": "Ӕ", "æ": "ӕ", "Ə": "Ә", "ə": "ә",
}

# Ranges that print nothing, beside the controls. Line breaks and tabs stay.
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)
# What is blank and left over when the invisible characters are gone.
BLANK = r"[\s\p{Z}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}]*"


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Compatibility forms of one character (widths, fonts, blanks, one-letter numerals), those
    of several (ligatures, numerals), and look-alikes with and without accents."""
    one, several = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        if unicodedata.category(ch) == "Zs":
            one[ch] = " "
            continue
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        to = "".join(chr(int(x, 16)) for x in rest.split())
        if kind in ("<wide>", "<narrow>", "<font>") or kind == "<compat>" and to.isalpha() and unicodedata.category(ch)[0] in "LN":
            to = unicodedata.normalize("NFKC", to)
            if len(to) == 1:
                one[ch] = to
            else:
                several[ch] = to
    one["ﾞ"], one["ﾟ"] = "゙", "゚"  # half-width voicing marks join the kana before
    alike = {ch: latin for latin, chars in LOOKALIKES.items() for ch in chars}
    for point in range(0x370, 0x2000):
        ch = chr(point)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0] in alike and len(to := unicodedata.normalize("NFC", alike[d[0]] + d[1:])) == 1:
            alike[ch] = to
    return one, several, alike


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """Regular-expression class of the characters, runs as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in out) + "]"


def _by_block(table: dict[str, str]) -> list[dict[str, str]]:
    """The table in parts of one kind, as translate costs each text the size of its table."""
    parts: dict[int, dict[str, str]] = {}
    for ch, to in table.items():
        p = ord(ch)
        if p >= 0xFF00:
            block = 1 if p < 0xFF61 and not to.isalnum() else 2 if p < 0xFF61 else 3
        else:
            block = 4 if p < 0x370 else 5 if p < 0x400 else 6 if p < 0x530 else 7 if 0x2000 <= p <= 0x3000 and to == " " else 8
        parts.setdefault(block, {})[ch] = to
    return [parts[k] for k in sorted(parts)]


def same_form(text: str) -> str:
    """DuckDB expression for the consistent form of the SQL expression ``text``.

    Texts of plain ASCII pass by; each table is only asked for texts that hold one of its characters."""
    one, several, alike = tables()
    steps = [lambda x: f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '{INVISIBLE}', '', 'g')"]
    guard = lambda chars, make: lambda x: f"(case when regexp_matches({x}, '{_class(chars)}') then {make(x)} else {x} end)"
    swap = lambda t: lambda x: f"translate({x}, {_quoted(''.join(t))}, {_quoted(''.join(t.values()))})"

    def spell(x: str) -> str:
        for ch, to in several.items():
            x = f"replace({x}, {_quoted(ch)}, {_quoted(to)})"
        return x

    steps += [guard("".join(several), spell), *(guard("".join(t), swap(t)) for t in _by_block(one)), lambda x: f"nfc_normalize({x})"]
    steps += [*(guard("".join(t), swap(t)) for t in _by_block(alike)), lambda x: f"nfc_normalize({x})"]
    # each step is a lambda of one list element, so that its input is computed once
    value = "x"
    chain = f"[{text}]"
    for step in steps:
        chain = f"list_transform({chain}, lambda x: {step(value)})"
    heavy = f"({chain})[1]"
    return f"(case when regexp_matches({text}, '[^\\x{{09}}\\x{{0A}}\\x{{20}}-\\x{{7E}}]') then {heavy} else {text} end)"
