"""Predicates and transformations of text as columns. White space, digits and letters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import bound

# Fixed patterns.
PAGE_NUMBER = r"(?i)^[ivxlcdm]{1,7}$|^(?U:\d){1,4}$"
FOOTNOTE_MARKER = r"^(?U:\s*)((?U:\d{1,3})[.)]?(?U:\s+\S)|\*(?U:\s+\S)|[¹²³⁴⁵⁶⁷⁸⁹])"
FOOTNOTE_PREFIX = r"^((?U:\d{1,3}))[.)]?(?U:\s+)"
BULLET = r"^[•∙◦‣·*-](?U:\s+)"
NUMBERED = r"^((?U:\d{1,3})|[a-zA-Z]|[ivxlcdm]{1,6})[.)](?U:\s+)"
#: What follows outer white space, as one pattern: a text is read once.
LIST_ITEM = rf"^(?U:\s*)(?:{BULLET[1:]}|{NUMBERED[1:]})"
SENTENCE_END = r"[.?!:;»”\"')\]]$"
#: Letters whose capital is several letters, and the one letter that Unicode has for each too.
_WITH_IOTA = [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8)]
ONE_CAPITAL = ("ß" + "".join(map(chr, _WITH_IOTA)) + "ᾳῃῳ", "ẞ" + "".join(chr(x + 8) for x in _WITH_IOTA) + "ᾼῌῼ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def has_mark(text: Column) -> Column:
    """Not only white space."""
    return text.rlike(r"(?U)\S")


def upper_letter(letter: Column) -> Column:
    """One letter's capital, as one letter: a sharp s and letters with an iota below have such, other letters without one stay."""
    whole = F.upper(letter)
    return F.when(F.length(whole) <= 1, whole).otherwise(F.translate(letter, *ONE_CAPITAL))


def looks_like_page_number(text: Column) -> Column:
    """Up to seven roman or four other digits, in dots, dashes and spaces."""
    bare = F.btrim(text, F.lit(" .-—–"))
    return (F.length(bare) <= 7) & bare.rlike(PAGE_NUMBER)


def looks_like_footnote_marker(text: Column) -> Column:
    """Outer white space aside, which the pattern skips: what follows a marker's space is not only space."""
    return text.rlike(FOOTNOTE_MARKER)


def footnote_marker(text: Column) -> Column:
    """The number before a footnote's text; null if there is none."""
    return F.nullif(F.regexp_extract(text, FOOTNOTE_PREFIX, 1), F.lit(""))


def without_footnote_marker(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE_PREFIX, "")


def is_bullet(text: Column) -> Column:
    return lstrip(text).rlike(BULLET)


def is_numbered(text: Column) -> Column:
    return ~is_bullet(text) & lstrip(text).rlike(NUMBERED)


def is_list_item(text: Column) -> Column:
    return text.rlike(LIST_ITEM)


def ends_sentence(text: Column) -> Column:
    """Ends in closing punctuation; an empty text does."""
    bare = rstrip(text)
    return (bare == "") | bare.rlike(SENTENCE_END)


def ends_cut(word: Column) -> Column:
    """A letter and a hyphen at the end."""
    return rstrip(word).rlike(r"\p{L}-$")


def begins_small(word: Column) -> Column:
    return word.rlike(r"^\p{Ll}")


def joins_hyphen(word: Column, following: Column) -> Column:
    """A word cut at a line's end: a letter and a hyphen, and the next word begins small."""
    return F.coalesce(ends_cut(word) & begins_small(following), F.lit(False))


def has_meaningful_text(text: Column, least: int = 20) -> Column:
    """At least ``least`` characters, line ends and outer space aside."""
    return F.coalesce(F.length(F.replace(strip(text), F.lit("\n"), F.lit(""))) >= least, F.lit(False))


def in_pairs(text: Column) -> Column:
    """A blank line behind every second line. Each match begins where the one before it ends and gives nothing back, so a line is read twice at most, however long."""
    return F.regexp_replace(text, r"\G([^\n]*+\n[^\n]*+)\n", "$1\n \n")


def line_pairs(text: Column) -> Column:
    """Every two lines as one with a space between, as they are: blank lines and all white space stay. Linear in the lines."""
    pair = lambda lines, k: F.concat(F.get(lines, 2 * k), F.coalesce(F.concat(F.lit(" "), F.get(lines, 2 * k + 1)), F.lit("")))
    made = bound(F.split(text, "\n"), lambda lines: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 1)), lambda k: pair(lines, k)))
    return F.when(text.isNotNull(), made)


def blank_line_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, none empty."""
    parts = F.transform(F.split(text, r"\n(?U:\s*)\n"), lambda p: strip(F.regexp_replace(p, r"(?U)\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


# Codes of languages, three letters to those of two kinds of recognition engines (fixed values).
NAMED_CODES = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "german", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru",
    "chi_sim": "ch", "chi_tra": "chinese_cht", "jpn": "japan", "kor": "korean", "ara": "ar",
}
SHORT_CODES = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru",
    "chi_sim": "ch_sim", "chi_tra": "ch_tra", "jpn": "ja", "kor": "ko", "ara": "ar",
}


def _looked_up(code: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code), F.lit(default))


def named_code(codes: Column, default: str = "en") -> Column:
    """The one code of an engine that takes the first language of a list."""
    return _looked_up(F.get(codes, F.lit(0)), NAMED_CODES, default)


def short_code(code: Column, default: str = "en") -> Column:
    return _looked_up(code, SHORT_CODES, default)


def short_codes(codes: Column, default: str = "en") -> Column:
    """Distinct codes of a list, in its order; never none."""
    found = F.array_distinct(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda x: short_code(x, default)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
