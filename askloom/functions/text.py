"""Text functions as columns: cleaning, normalising, tokens, sentences, truncation.

Everything is a built-in expression except HTML unescaping and Unicode
normalisation, which have none and go through Arrow.  Null counts as "".
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Texts that are Python's at a time.
FEW = 256
#: All characters that Unicode counts as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def named(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` made once for a row, however often ``use`` looks at it."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def rfind(c: Column, what: str) -> Column:
    """The last position of a character, from 0; -1 if it isn't there."""
    at = F.instr(F.reverse(c), what)
    return F.when(at > 0, F.length(c) - at).otherwise(-1)


def split_words(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(_text(c), P.u(r"\s+")), lambda w: w != "")


def _arrow(kind: str):
    """An Arrow function as a column function; it is only made once a session is there."""

    def made(f):
        return lambda *columns: F.arrow_udf(f, kind)(*columns)

    return made


def _changed(texts: pa.Array, some: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``texts`` with those changed that ``some`` marks; only they become Python's, a few at a time."""
    at = np.flatnonzero(some.fill_null(False).to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    made = pa.chunked_array(
        [pa.array([change(t) for t in texts.take(pa.array(at[a : a + FEW])).to_pylist()], pa.string()) for a in range(0, len(at), FEW)]
    )
    return pc.replace_with_mask(texts, some.fill_null(False), made.combine_chunks())


@_arrow("string")
def _unescape(texts: pa.Array) -> pa.Array:
    return _changed(texts, pc.match_substring(texts, "&"), html.unescape)


@_arrow("string")
def _nfc(texts: pa.Array) -> pa.Array:
    return _changed(texts, pc.invert(pc.string_is_ascii(texts)), lambda t: unicodedata.normalize("NFC", t))


def html_unescape(c: Column | str) -> Column:
    return _unescape(_text(c))


def nfc(c: Column | str) -> Column:
    return _nfc(_text(c))


def _squeeze(c: Column) -> Column:
    c = F.regexp_replace(c, P.u(P.SPECIAL_SPACES), " ")
    c = F.regexp_replace(c, P.MANY_SPACES, " ")
    return F.regexp_replace(c, P.MANY_NEWLINES, "\n\n")


def clean_unescaped(c: Column) -> Column:
    """``clean_text`` after the unescaping."""
    c = F.regexp_replace(c, P.HTML_TAG, " ")
    phrases = P.ius("|".join(f"(?:{p})" for p in P.SERVICE_PHRASES))
    # all phrases start with one of these, and most texts in other scripts hold none
    some = c.rlike(r"[\u0400-\u04FF\[]|<!-")
    return strip(_squeeze(F.when(some, F.regexp_replace(c, phrases, " ")).otherwise(c)))


def clean_text(c: Column | str) -> Column:
    """A document before chunking: entities, tags, service phrases and spaces."""
    return clean_unescaped(html_unescape(c))


def strip_chunk_id(c: Column) -> Column:
    return F.regexp_replace(c, P.u(P.CHUNK_ID_PREFIX), "")


def strip_markup(c: Column) -> Column:
    """Tags and what is left of entities, after the unescaping."""
    return F.regexp_replace(F.regexp_replace(c, P.HTML_TAG, " "), P.BROKEN_ENTITY, " ")


def strip_html(c: Column | str) -> Column:
    return strip_markup(html_unescape(c))


def normalize_whitespace(c: Column) -> Column:
    return _squeeze(c)


def remove_decorative(c: Column) -> Column:
    return F.regexp_replace(c, P.DECORATIVE, "")


def trim_incomplete(c: Column) -> Column:
    """Without a last sentence that doesn't end, unless it is the only one."""
    c = F.rtrim(c, F.lit(WHITE))
    cut = F.regexp_extract(c, r"(?s)^(.*[.!?»])", 1)
    return F.when(c.rlike(r'[.!?»")]$') | (cut == ""), c).otherwise(cut)


def clean_chunk_unescaped(c: Column, min_length: int = 20, trim: bool = True) -> Column:
    """What ``clean_chunk`` does after its prefixes went and entities were unescaped."""
    c = remove_decorative(normalize_whitespace(strip_markup(c)))
    c = strip(trim_incomplete(c) if trim else c)
    return F.when(F.length(c) < min_length, "").otherwise(c)


def clean_chunk(c: Column | str, min_length: int = 20, trim: bool = True) -> Column:
    """A chunk for the context: "" if less than ``min_length`` characters are left."""
    c = F.regexp_replace(strip_chunk_id(_text(c)), P.iu(P.CONTEXT_HEADER), "")
    return clean_chunk_unescaped(html_unescape(c), min_length, trim)


def fold_yo(c: Column) -> Column:
    return F.translate(c, "ёЁ", "еЕ")


def normalize_for_embedding(c: Column | str) -> Column:
    """One spelling of ё, composed characters, single spaces; case is kept."""
    return strip(F.regexp_replace(nfc(fold_yo(_text(c))), P.MANY_SPACES, " "))


def chunk_hash(c: Column | str) -> Column:
    """Equal for chunks that differ in case, spacing or ё only: 32 hexadecimal digits."""
    return F.substring(F.sha2(strip(F.lower(normalize_for_embedding(c))), 256), 1, 32)


def tokenize(c: Column | str) -> Column:
    """Tokens of lexical search: letters, digits and _, two at least; ё stays ё."""
    clean = F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 1)


def sparse_tokens(c: Column | str) -> Column:
    """Tokens of sparse vectors: runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def normalize_text(c: Column | str) -> Column:
    return F.translate(F.lower(_text(c)), "ё", "е")


# --- sentences ---

#: Abbreviations that something has to follow.
HEAD_ABBREVIATIONS = [
    "г", "ул", "пр", "просп", "пер", "пл", "д", "кв", "корп", "оф", "стр", "им", "тел", "св", "проф", "акад", "доц", "гл", "рис",
    "табл", "см", "ср", "напр", "т\\.?[ ]?е", "т\\.?[ ]?к", "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "Fig", "e\\.g", "i\\.e",
]
#: Abbreviations that may end a sentence, and don't before a number.
TAIL_ABBREVIATIONS = [
    "гг", "вв", "руб", "коп", "тыс", "млн", "млрд", "долл", "др", "проч", "мин", "сек", "кг", "км", "Inc", "Ltd", "Corp", "etc", "al",
    "a\\.m", "p\\.m",
]
#: Pairs whose last part would be a head by itself: and so on, of our era.
TAIL_PAIRS = [r"т\.[ ]?[дп]", r"н\.[ ]?э"]
#: How far from a candidate what is open may have been opened, and may be closed.
WINDOW = 300

_EDGE = r"(?:^|[^\p{L}\p{N}])"
_WS = r"[ \t\r\n]"
#: A candidate's place, which is marked: behind the marks of an end and what closes after them, before white space.
_CANDIDATE = r"([.!?…;]+[»”’\"')\]]*)(?=[ \t\r\n])"


def _after(left: str, right: str = "") -> str:
    """A marked place with ``left`` before and ``right`` behind it; the mark comes first, so that nothing is tried elsewhere."""
    return "\u0001" + (f"(?<={left}\u0001)" if left else "") + (f"(?={_WS}*(?:{right}))" if right else "")


def _inside(opens: str, closes: str) -> str:
    """A marked place in what is opened before it and closed behind it."""
    return "\u0001" + rf"(?=[^{opens}{closes}]{{0,{WINDOW}}}{closes})(?<={opens}[^{opens}{closes}]{{0,{WINDOW}}}\u0001)"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


#: A number of up to four parts; Java wants no loops where it looks back.
_NUMBER = r"\p{N}{1,3}" + r"(?:\.\p{N}{1,3})?" * 3
#: Where a sentence goes on; in this order, as list marks depend on what is left of the marks before them.
SENTENCE_RULES = {
    "a lower-case word, also behind what opens or a dash, or a mark that goes on": _after(
        "", r"[«“„\"'(\[]*\p{Ll}|[—–-][ \t]*\p{Ll}|[.,:;!?…%)\]»”]"
    ),
    "initials": _after(_EDGE + r"\p{Lu}\."),
    "abbreviations of what follows": _after(rf"{_EDGE}{_any(HEAD_ABBREVIATIONS)}\.") + rf"(?<!{_EDGE}{_any(TAIL_PAIRS)}\.\u0001)",
    "abbreviations before a number": _after(rf"{_EDGE}{_any(TAIL_ABBREVIATIONS + TAIL_PAIRS)}\.", r"\p{N}"),
    # how such a mark ends comes first, as most places fail there
    "the mark of a list item": _after(r"(?:[\p{N}IVXLC.)][.)]|\p{L}\))")
    + rf"(?<=(?:^|\u0001){_WS}{{0,20}}(?:{_NUMBER}[.)]{{1,2}}|[IVXLC]{{1,5}}[.)]{{1,2}}|\p{{L}}\)\.?)\u0001)",
    "brackets": _inside(r"\(", r"\)"),
    "angle quotes": _inside("«", "»"),
    "curly quotes": _inside("“", "”"),
    "straight quotes": "\u0001" + rf"(?<=(?:^|[\s(])\"[^\"\s][^\"]{{0,{WINDOW}}}\u0001)(?=[^\"]{{0,{WINDOW}}}[^\"\s]\"(?:[\s.,;:!?…)]|$))",
}
#: What a text has to hold for a rule that looks far around each candidate.
_HOLDS = {"brackets": "()", "angle quotes": "«»", "curly quotes": "“”", "straight quotes": '"'}
#: Never matches.
_NEVER = "\u0001(?!)"


def _marked(text: Column) -> Column:
    """A text with \\u0001 where a sentence ends."""
    c = F.regexp_replace(text, _CANDIDATE, "$1\u0001")
    for name, rule in SENTENCE_RULES.items():
        # most texts hold neither brackets nor quotes, and aren't looked through for them
        held = [F.contains(text, F.lit(mark)) for mark in _HOLDS.get(name, "")]
        c = F.regexp_replace(c, F.when(reduce(and_, held), rule).otherwise(_NEVER) if held else F.lit(rule), F.lit(""))
    return c


def split_sentences(c: Column | str) -> Column:
    """Sentences, trimmed and not empty.

    Candidates are the places behind ``.``, ``!``, ``?``, ``…`` or ``;`` and
    closing marks, before white space.  ``SENTENCE_RULES`` look at either side of a
    candidate, and each takes away those at which a sentence goes on: before a
    lower-case word or a mark, after an initial, after abbreviations (of which
    some end a sentence unless a number follows), after the mark of a list item,
    and inside of brackets and quotes.  Each looks a bounded way back, so a text
    costs what its length is.
    """
    pieces = named(_text(c), lambda t: F.split(_marked(t), "\u0001"))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def split_long_sentences(c: Column | str) -> Column:
    """Sentences of two words or more."""
    return F.filter(split_sentences(c), lambda s: s.rlike(P.u(r"\s")))


def clean_context_sentence(c: Column) -> Column:
    c = strip(F.regexp_replace(c, P.iu(P.CONTEXT_HEADER), ""))
    c = F.regexp_replace(c, "(?i)" + P.PASSWORD_RUN, "")
    c = F.regexp_replace(c, P.iu(P.TRAILING_CONTEXT), "")
    return strip(F.regexp_replace(c, P.u(r"\s+"), " "))


def is_prompt_metadata(c: Column) -> Column:
    return strip(c).rlike(P.iu(P.PROMPT_LABEL))


def is_junk_sentence(c: Column) -> Column:
    c = strip(c)
    return (c == "") | c.rlike(P.iu("|".join(P.JUNK_SENTENCES)))


def word_stems(word: Column) -> Column:
    """A word, and what is left of it without each of the usual endings that it has."""
    ends = F.filter(F.array(*[F.lit(e) for e in P.ENDINGS]), lambda e: F.endswith(word, e))
    less = F.transform(ends, lambda e: F.substr(word, F.lit(1), F.length(word) - F.length(e)))
    return F.concat(F.array(word), less)


def holds_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def word_matches(word: Column, text: Column) -> Column:
    """Whether a text holds a word, or the word less one of its usual endings."""
    return holds_any(text, word_stems(word))


def drop_bracket_prefix(c: Column) -> Column:
    """Without everything up to the first "] ", if the text starts with "[" and more."""
    at = F.instr(c, "] ")
    return F.when(F.startswith(c, F.lit("[")) & (at > 1), F.substr(c, at + 2)).otherwise(c)


def _cut_after(c: Column, marks: list[str], least: Column) -> list[Column]:
    """For each mark in turn: the text up to its last place, if that is beyond ``least``, or null."""
    return [F.when(rfind(c, m) > least, F.substr(c, F.lit(1), rfind(c, m) + 1)) for m in marks]


def truncate_words(c: Column | str, most: int) -> Column:
    words = split_words(_text(c))
    cut = F.array_join(F.slice(words, 1, most), " ")
    ends = _cut_after(cut, [".", "!", "?"], F.length(cut) * 0.5)
    return F.when(F.size(words) <= most, _text(c)).otherwise(F.coalesce(*ends, cut))


def truncate_chars(c: Column | str, most: int) -> Column:
    """Up to a sentence's end, or else to a space, or else anywhere."""

    def shorter(cut: Column) -> Column:
        ends = _cut_after(cut, [".", "!", "?", "»"], F.lit(most * 0.3))
        space = F.when(rfind(cut, " ") > most * 0.5, F.substr(cut, F.lit(1), rfind(cut, " ")))
        return F.coalesce(*ends, space, cut)

    return named(_text(c), lambda t: F.when(F.length(t) <= most, t).otherwise(named(F.substring(t, 1, most), shorter)))


def truncate_sentences(c: Column | str, most: int) -> Column:
    def first(t: Column) -> Column:
        return named(split_sentences(t), lambda s: F.when(F.size(s) <= most, t).otherwise(F.array_join(F.slice(s, 1, most), " ")))

    return named(_text(c), first)


def cap_context(c: Column, most: int = 3200, least: int = 2200) -> Column:
    """A context of at most ``most`` characters, cut after a sentence if that leaves more than ``least``."""
    cut = F.substring(c, 1, most)
    end = F.greatest(*[rfind(cut, m) for m in (".", "!", "?", "»")])
    whole = F.when(end > least, F.substr(cut, F.lit(1), end + 1)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(whole)
