"""Column expressions for text: folding to ASCII, normalisation and tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose ASCII form is longer than one character, or is no letter.
EXPANSIONS = {
    "ß": "ss", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "þ": "th", "Þ": "Th", "…": "...", "€": "EUR",
    "°": "deg", "«": "<<", "»": ">>", "—": "--", "ﬁ": "fi", "ﬂ": "fl",
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps",
}
EXPANSIONS |= {c.upper(): ascii_form.capitalize() for c, ascii_form in EXPANSIONS.items() if c in "жхцчшщюяёθφχψ"}
# Cyrillic and Greek letters and their ASCII forms, in the order of the alphabets.
ALPHABETS = (("абвгдезийклмнопрстуфыэьъ", "abvgdeziiklmnoprstufye'\""), ("αβγδεζηικλμνξοπρστυωςάέήίόύώ", "abgdeziiklmnxoprstuosaeiiouo"))
SINGLES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", " ": " "}


def _folded() -> tuple[str, str]:
    """Letters and their bases, wherever a compatibility decomposition starts with an ASCII letter."""
    pairs = dict(SINGLES)
    for letters, forms in ALPHABETS:
        pairs |= dict(zip(letters, forms, strict=True)) | {c.upper(): f.upper() for c, f in zip(letters, forms) if len(c.upper()) == 1 and c != "ς"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)
        if c not in EXPANSIONS and c not in pairs and base[0].isascii() and base[0].isalpha() and all(map(unicodedata.combining, base[1:])):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


FROM, TO = _folded()


_LONG = "".join(EXPANSIONS)
_FOLDED = str.maketrans(dict(zip(FROM, TO)) | EXPANSIONS)


def fold(text: Column) -> Column:
    """ASCII form of accented, Greek and Cyrillic letters, ligatures and typographic signs; other characters stay.

    Most texts need few of the steps: ASCII ones none, those without characters that expand no replacement.
    """
    short = F.translate(text, FROM, TO)
    whole = reduce(lambda out, e: F.replace(out, F.lit(e[0]), F.lit(e[1])), EXPANSIONS.items(), short)
    return F.when(F.octet_length(text) == F.length(text), text).when(F.translate(text, _LONG, "") != text, whole).otherwise(short)


def folded(text: str) -> str:
    """fold() of one text on the driver."""
    return text.translate(_FOLDED)


#: . , : that are not between digits
LOOSE_NUMERIC = r"(?<![0-9])[.,:]|[.,:](?![0-9])"
#: ' - that are not between letters
LOOSE_WORD = r"(?<![A-Za-z])['\-]|['\-](?![A-Za-z])"
#: ( ) around letters, digits, a . between digits or a - between letters
KEPT_PARENS = r"\(((?:[A-Za-z0-9]|(?<=[0-9])\.(?=[0-9])|(?<=[A-Za-z])-(?=[A-Za-z]))+)\)"
_OPEN, _CLOSE = "\u0001", "\u0002"


def numeric_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, LOOSE_NUMERIC, " ")


def word_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, LOOSE_WORD, " ")


def kept_parens(text: Column) -> Column:
    """Array of the contents of the parentheses that stay."""
    return F.regexp_extract_all(fold(text), F.lit(KEPT_PARENS), F.lit(1))


#: ASCII signs and white space that never stay.
_PLAIN = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in " .,:'-()")
#: LOOSE_NUMERIC, LOOSE_WORD and all other signs but spaces. Letters fail its first test, one of a table; a sign alone looks around.
_LOOSE = rf"\W(?<![ {_OPEN}{_CLOSE}])(?!(?<=[0-9][.,:])[0-9]|(?<=[A-Za-z]['\-])[A-Za-z])"


def _bare(text: Column) -> Column:
    """ASCII words and spaces; one pass decides on every sign by its neighbours in the folded text."""
    whole = F.translate(fold(text), _PLAIN, " " * len(_PLAIN))
    marked = F.when(F.contains(whole, F.lit("(")), F.regexp_replace(whole, KEPT_PARENS, f"{_OPEN}$1{_CLOSE}")).otherwise(whole)
    return F.lower(F.translate(F.regexp_replace(marked, _LOOSE, " "), _OPEN + _CLOSE, "()"))


def normalize(text: Column) -> Column:
    """Lower-case ASCII words with single spaces."""
    return F.trim(F.regexp_replace(_bare(text), "  +", " "))


def normalized(text: str) -> str:
    """normalize() of one text on the driver, by the same patterns; for queries."""
    marked = re.sub(KEPT_PARENS, f"{_OPEN}\\1{_CLOSE}", folded(text).translate(str.maketrans(_OPEN + _CLOSE, "  ")))
    bare = re.sub(rf"[^A-Za-z0-9.,:'\-{_OPEN}{_CLOSE}]|{LOOSE_NUMERIC}|{LOOSE_WORD}", " ", marked)
    return " ".join(bare.translate(str.maketrans(_OPEN + _CLOSE, "()")).split()).lower()


def words(text: Column) -> Column:
    """Array of the words of text; null and empty texts have none."""
    return F.array_remove(F.split(_bare(F.coalesce(text, F.lit(""))), " "), "")


#: Kinds of bytes of a folded text: letters, digits, signs between digits, signs between letters, parentheses; 0: all others.
_LETTER, _DIGIT, _NUMERIC, _WORD, _LEFT, _RIGHT = 1, 2, 4, 8, 16, 32
_KINDS = np.zeros(256, np.uint8)
for _kind, _signs in ((_LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_NUMERIC, b".,:"), (_WORD, b"'-"), (_LEFT, b"("), (_RIGHT, b")")):
    _KINDS[np.frombuffer(_signs, np.uint8)] = _kind
_FORMS = {int.from_bytes(c.encode()): (c.encode(), form.encode()) for c, form in [*zip(FROM, TO), *EXPANSIONS.items()]}
_LONG_FORMS = {code: pair for code, pair in _FORMS.items() if len(pair[1]) > len(pair[0])}
#: A byte that no UTF-8 text holds.
_END = b"\xff"


def _folded_bytes(data: bytes) -> np.ndarray:
    """fold() of UTF-8 as bytes. Forms that need no more bytes than their characters are put in their places, the few others are replaced before."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(raw[:-2] >= 0xC2)
    if not len(at):
        return raw
    lead, second = raw[at].astype(np.int32), raw[at + 1]
    codes, kinds = np.unique(np.where(lead < 0xE0, lead << 8 | second, lead << 16 | second.astype(np.int32) << 8 | raw[at + 2]), return_inverse=True)
    if long := _LONG_FORMS.keys() & codes.tolist():
        for code in long:
            data = data.replace(*_LONG_FORMS[code])
        return _folded_bytes(data)
    raw, stay = raw.copy(), np.ones(len(raw), bool)
    forms = [_FORMS.get(code, (b"", b"")) for code in codes.tolist()]
    for k in range(3):
        width, size = (np.array([len(f[i]) for f in forms])[kinds] for i in (0, 1))
        put, gone = at[size > k] + k, at[(width > k) & (size <= k)] + k
        raw[put] = np.array([f[1][k : k + 1] or b" " for f in forms], "S1").view(np.uint8)[kinds[size > k]]
        stay[gone] = False
    return raw[stay]


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, one text after another; how many each has) of an Arrow array, as words() has them.

    All bytes are decided on at once, each by its kind and its neighbours'.
    """
    rows = [r or b"" for r in texts.cast(pa.binary()).to_pylist()]
    data = _END.join([*rows, b"", b""])
    if data.count(_END) != len(rows) + 1:  # no UTF-8
        data = _END.join([*(r.replace(_END, b" ") for r in rows), b"", b""])
    raw = _folded_bytes(data)
    kind = np.frombuffer(raw.tobytes().translate(_KINDS), np.uint8)
    alone = (kind & (_LETTER | _DIGIT)) > 0
    between = np.zeros((2, len(raw)), bool)
    for out, sign, side in ((between[0], _NUMERIC, _DIGIT), (between[1], _WORD, _LETTER)):
        out[1:-1] = (kind[1:-1] == sign) & (kind[:-2] == side) & (kind[2:] == side)
    kept = alone | between[0] | between[1]
    if b"(" in data:
        inner = alone | (between[0] & (raw == ord("."))) | (between[1] & (raw == ord("-")))
        stops = np.flatnonzero(~inner)
        opens = np.flatnonzero((kind[stops[:-1]] == _LEFT) & (kind[stops[1:]] == _RIGHT) & (np.diff(stops) > 1))
        kept[stops[opens]] = kept[stops[opens + 1]] = True
    edges = np.flatnonzero(np.diff(kept, prepend=False))  # the last byte is no word's
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - starts))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kept].tobytes().lower())).cast(pa.string())
    return found, np.diff(np.searchsorted(starts, np.flatnonzero(raw == _END[0])[: len(rows)]), prepend=0)


#: Bytes of texts whose words are found at once, about.
AT_ONCE = 4_000_000


def word_arrays(texts: pa.Array) -> pa.Array:
    """The words of each text of an Arrow array; a null has none."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(lengths) // AT_ONCE)) + 1).tolist()
    found, sizes = zip(*(text_words(texts.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(texts)])))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.concat_arrays(found))


def bulk_words(text: Column | str) -> Column:
    """words() of a column, those of many texts at once; a null has none."""
    return F.arrow_udf(word_arrays, "array<string>")(text)


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(fold(text)), F.lit("[a-z]+"), F.lit(0))
