"""Characters that look alike: tables and the mapping of one text."""

from __future__ import annotations

import re
import unicodedata

# Ranges (hexadecimal) of Unicode's Default_Ignorable_Code_Point property.
IGNORABLE = (
    "00AD-00AD 034F-034F 061C-061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164-3164 FE00-FE0F "
    "FEFF-FEFF FFA0-FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
)
# Spaces other than the usual one, and line ends other than \n.
SPACES = "0009-0009 000B-000C 00A0-00A0 1680-1680 2000-200A 202F-202F 205F-205F 3000-3000"
LINE_ENDS = "0085-0085 2028-2029"


def char_class(ranges: str) -> str:
    """The inside of a regular expression's class for hexadecimal ranges."""
    return "".join("-".join(re.escape(chr(int(x, 16))) for x in r.split("-")) for r in ranges.split())


#: Texts that this does not match are left as they are by visible(): ASCII, Latin-1 letters, dashes, quotes, bullet, currency signs.
MAY_CHANGE = "[^\\x00-\\x7F\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF\\u2013\\u2014\\u2018-\\u201D\\u2022\\u20AC\\u20B9\\u00A3]"

# Letters of other alphabets, and of phonetic script, with the Latin letter of the same shape.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I",
    "Ғ": "F", "Ё": "Ë",
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h", "ӏ": "l",
    "ѵ": "v", "ё": "ë", "г": "r", "п": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    "ք": "p", "ա": "w", "ռ": "n",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y",
    "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮖ": "I", "Ꮞ": "S", "Ꮟ": "b", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # phonetic script
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ʙ": "b", "ɢ": "g", "ʜ": "h",
    "ɛ": "e", "ʋ": "v", "ı": "i", "ɯ": "w", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m",
    "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
#: Small capitals of phonetic script by their names, as the table above has most of them.
LOOK_ALIKES |= {
    chr(c): m[1].lower()
    for c in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800))
    if chr(c) not in LOOK_ALIKES and (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(c), "")))
}
_IGNORED = re.compile(f"[{char_class(IGNORABLE)}]")
_SPACE = re.compile(f"[{char_class(SPACES)}]")
_LINE = re.compile(f"\r\n?|[{char_class(LINE_ENDS)}]")
_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "]")
_WORD = re.compile(r"[^\W\d_]+")
_SINGLE = str.maketrans(LOOK_ALIKES)


def _word(m: re.Match) -> str:
    """A word that is Latin, as most of its letters without a Latin look-alike are, with Latin letters alone."""
    w = m.group()
    if w.isascii() or not _ALIKE.search(w):
        return w
    own = [c for c in w if c not in LOOK_ALIKES]
    latin = sum(c.isascii() or "LATIN" in unicodedata.name(c, "") for c in own)
    return w.translate(_SINGLE) if 2 * latin > len(own) else w


def visible(text: str) -> str:
    """text with compatibility forms composed, no invisible characters, look-alikes in Latin words as Latin
    letters. Words wholly in another alphabet, line ends and tabs stay."""
    if text.isascii():
        return text
    out = unicodedata.normalize("NFKC", _IGNORED.sub("", text)).replace(chr(0x1680), " ")
    out = _IGNORED.sub("", out)
    if _ALIKE.search(out):
        out = unicodedata.normalize("NFC", _WORD.sub(_word, out))
    return out


def one_form(text: str) -> str:
    """The form in which texts are compared: visible(), case folded, all spaces usual ones, line ends \\n."""
    if text.isascii():
        return _SPACE.sub(" ", _LINE.sub("\n", text)).lower()
    out = _LINE.sub("\n", _SPACE.sub(" ", visible(text)))
    return unicodedata.normalize("NFKC", out.casefold())
