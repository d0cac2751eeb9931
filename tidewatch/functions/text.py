"""Text functions on Columns: folding, names, check digits, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and what is left without the marks.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
# Consonant classes of the phonetic key.
PHONETIC = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}


def _unmark(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, MARKED, PLAIN), "\\p{Mn}", "")


def fold(x: Column) -> Column:
    """For keywords: capital I without a dot becomes the letter i, as does the small dotless one."""
    return F.translate(_unmark(F.lower(F.translate(x, "Iİ", "ıi"))), "ı", "i")


def normalise(x: Column) -> Column:
    """For names: lower case, no marks, single spaces."""
    return F.trim(F.regexp_replace(F.translate(_unmark(F.lower(x)), "ı", "i"), "\\s+", " "))


def fuzzy_form(x: Column) -> Column:
    """A normalised name without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalise(x), "[^\\p{L}\\p{N}_\\s]", " "), "\\s+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def phonetic(token: Column) -> Column:
    """First letter and three consonant classes; equal neighbours count once, any other letter parts them."""
    word = F.replace(fuzzy_form(token), F.lit(" "), F.lit(""))
    letters, digits = "".join(PHONETIC), "".join(v * len(k) for k, v in PHONETIC.items())
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.regexp_replace(F.translate(c, letters, digits), "[^1-6]", "0"))
    kept = F.filter(F.transform(codes, lambda c, i: F.when((i > 0) & (c != "0") & (c != F.get(codes, i - 1)), c).otherwise("")), lambda c: c != "")
    return F.when(word == "", "").otherwise(F.rpad(F.substring(F.concat(F.substring(word, 1, 1), F.array_join(kept, "")), 1, 4), 4, "0"))


def ngrams(token: Column, n: int = 3) -> Column:
    """Distinct n-grams of a word between underscores."""
    word = F.concat(F.lit("_"), F.replace(fuzzy_form(token), F.lit(" "), F.lit("")), F.lit("_"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - n + 1)), lambda i: F.substring(word, i, F.lit(n))))


def mask_name(x: Column) -> Column:
    """Each word's first letter and stars for the rest, one at least."""
    return F.array_join(F.transform(tokens(F.regexp_replace(x, "\\s+", " ")), lambda p: F.concat(F.substring(p, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(p) - 1)))), " ")


def digest(kind: str, value: Column, salt: str) -> Column:
    """Salted hash that banks can exchange."""
    return F.sha2(F.concat_ws("|", F.lit(salt), F.lit(kind), F.upper(F.regexp_replace(value, "\\s+", ""))), 256)


def iban_valid(x: Column) -> Column:
    """Two letters, two digits, a body, and a remainder of 1 by 97."""
    v = F.upper(F.regexp_replace(x, "\\s+", ""))
    moved = F.concat(F.substring(v, 5, 34), F.substring(v, 1, 4))
    digits = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(digits, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.coalesce(F.when(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1), F.lit(False))


def iban_check_digits(bban: Column, country: str = "TR") -> Column:
    text = F.concat(bban, F.lit(country), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def luhn_valid(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    every = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.coalesce((F.length(digits) >= 13) & (F.length(digits) <= 19) & (F.aggregate(every, F.lit(0), lambda a, d: a + d) % 10 == 0), F.lit(False))


def tckn_valid(x: Column) -> Column:
    """Eleven digits whose last two follow from the others."""
    d = [F.substring(x, i, 1).cast("int") for i in range(1, 12)]
    tenth = (((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7])) % 10 + 10) % 10
    eleventh = sum(d[1:10], d[0]) % 10
    return F.coalesce(x.rlike("^[1-9][0-9]{10}$") & (d[9] == tenth) & (d[10] == eleventh), F.lit(False))


# What is masked, in the order of masking.
REDACTIONS = [
    ("IBAN", "\\bTR[0-9]{2}(?: ?[0-9]){22}\\b"),
    ("IBAN", "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\\b"),
    ("EMAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"),
    ("CARD", "\\b[0-9](?:[ -]?[0-9]){12,18}\\b"),
    ("TCKN", "\\b[1-9][0-9]{10}\\b"),
    ("PHONE", "(?:\\+90|\\b0)[ -]?5[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}\\b"),
]


def redact(x: Column) -> Column:
    for kind, pattern in REDACTIONS:
        x = F.regexp_replace(x, pattern, f"[{kind}]")
    return x


def csv_cell(x: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(x.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def amount_text(x: Column) -> Column:
    """Amounts in words of thousands and millions."""
    return F.when(x >= 1e6, F.concat(F.format_string("%.1f", x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(F.format_string("%.0f", x / 1e3), F.lit("K"))).otherwise(F.format_string("%.0f", x))


def template(source: str, known: set[str]) -> Column:
    """A reason text: ``{name:.1f}`` places a number, with a decimal comma; unknown names give ``?``."""
    import string

    parts: list[Column] = []
    try:
        for literal, name, spec, _ in string.Formatter().parse(source):
            parts.append(F.lit(literal))
            if name is None:
                continue
            if name not in known:
                parts.append(F.lit("?"))
            elif spec.endswith("f"):
                parts.append(F.coalesce(F.translate(F.format_string("%" + spec, F.col(name).cast("double")), ".", ","), F.lit("?")))
            else:
                parts.append(F.coalesce(F.col(name).cast("string"), F.lit("?")))
    except ValueError:
        return F.lit(source)
    return F.concat(*parts)
