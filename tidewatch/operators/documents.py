"""Texts about customers and payments: reversible redaction, descriptions, hashed embeddings, citations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

_SEP = "[ \\-.]?"
# What is replaced, in this order; a candidate counts only if its check digits hold, where there are any.
PATTERNS = [
    ("IBAN", f"(?i)\\bTR(?:{_SEP}\\d){{24}}(?![ \\-.]?\\d)", None),
    ("IBAN", f"(?i)\\b[A-Z]{{2}}{_SEP}\\d{{2}}(?:{_SEP}[A-Z0-9]{{4}}){{2,7}}(?:{_SEP}[A-Z0-9]{{1,3}})?\\b", "iban"),
    ("EPOSTA", "\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b", None),
    ("KART", "(?<![\\w\\-.])(?:[2-69]\\d(?:[ \\-]?\\d){11,17}(?![ \\-]?\\d)|[2-69]\\d{3}(?:\\.\\d{4}){3}(?:\\.\\d{1,3})?)(?!\\.?\\d)", "luhn"),
    ("TCKN", "(?<!\\d)(?<!\\d[ \\-])[1-9](?:[ \\-]?\\d){10}(?![ \\-]?\\d)", "tckn"),
    ("TELEFON", "(?<![\\w+])(?:\\+?90[ \\-.]?|0[ \\-.]?)?\\(?5\\d{2}\\)?[ \\-.]?\\d{3}[ \\-.]?\\d{2}[ \\-.]?\\d{2}(?![ \\-.]?\\d)", None),
]
# First names that tell a person in free text, those that are words too, and words that are no surname.
FIRST_NAMES = """Ahmet Mehmet Mustafa Ali Hüseyin Hasan İbrahim İsmail Osman Yusuf Murat Ömer Ramazan Halil Süleyman Abdullah Mahmut Recep Salih
Fatih Kadir Emre Hakan Kemal Burak Serkan Can Cem Deniz Tuna Mert Onur Volkan Kerem Emir Arda Barış Tolga Selim Kaan Anıl Ayşe Fatma Emine
Hatice Zeynep Elif Meryem Şerife Zehra Sultan Hanife Merve Özlem Esra Büşra Selin Derya Ebru Gül Sevgi Aslı Ceren Ece Buse Damla Gizem İrem
Nur Sibel""".split()
AMBIGUOUS = ("can", "deniz", "nur", "gul", "sultan", "ece", "ay", "umut")
NOT_SURNAMES = ("ile", "ve", "veya", "icin", "için", "bey", "hanim", "hanım", "adina", "adına", "de", "da", "ki", "mi", "gibi")

#: Letters that fold to one, by the plain letter: in both cases, with all marks.
_VARIANTS = {p: p + p.upper() + "".join(m + m.upper() for m, q in zip(tx.MARKED, tx.PLAIN, strict=True) if q == p) + ("ıİ" if p == "i" else "") for p in sorted({*tx.PLAIN, "i"})}
_LETTER = "A-Za-zÇĞİÖŞÜçğıöşü"


def _any_case(name: str) -> str:
    """A pattern for a name in any case, with or without marks."""
    out = ""
    for ch in name:
        plain = next((p for p, v in _VARIANTS.items() if ch in v), None)
        out += f"[{_VARIANTS[plain]}]" if plain else f"[{ch.lower()}{ch.upper()}]"
    return out


def _capital(name: str) -> str:
    return name[0] + _any_case(name)[len(_any_case(name[0])) :]


def person_pattern() -> str:
    """A first name, perhaps more of them, and a surname. Names that are words too count only with a capital."""
    plain = [n for n in FIRST_NAMES if tx_plain(n) not in AMBIGUOUS]
    words = [n for n in FIRST_NAMES if tx_plain(n) in AMBIGUOUS]
    # names by their first letter, so that a word is held against those alone that may be it; letters beyond ASCII stand
    # apart behind one test, since a class that holds them costs many times one that does not
    starts: dict[str, list[str]] = {}
    for n in plain:
        head = _any_case(n[0])
        starts.setdefault(head, []).append(_any_case(n)[len(head) :])

    def of(beyond: bool) -> list[str]:
        heads = {h: "".join(c for c in h[1:-1] if (ord(c) > 127) == beyond) for h in starts}
        return [f"[{own}](?:{'|'.join(starts[h])})" for h, own in heads.items() if own] + [_capital(w) for w in words if (ord(w[0]) > 127) == beyond]

    first = "(?:" + "|".join([*of(False), f"(?=[^\\x00-\\x7F])(?:{'|'.join(of(True))})"]) + ")"
    surname = f"(?!(?:{'|'.join(NOT_SURNAMES)})(?![{_LETTER}]))(?:[A-ZÇĞİÖŞÜ][{_LETTER}]+|[a-zçğıöşü][{_LETTER}]{{2,}})(?![{_LETTER}])"
    return f"(?<![\\w]){first}(?![{_LETTER}])(?:[ \\t]+{first}(?![{_LETTER}])(?=[ \\t]+[{_LETTER}]))*\\s+{surname}"


def tx_plain(name: str) -> str:
    """The folded form of a fixed name."""
    out = name.replace("İ", "i").replace("I", "i").lower()
    return "".join(tx.PLAIN[tx.MARKED.index(c)] if c in tx.MARKED else c for c in out).replace("ı", "i")


def _name_pattern(name: Column) -> Column:
    """A pattern that holds for a name whatever its case, marks and white space."""
    out = F.regexp_replace(tx.fold(F.trim(name)), "[^\\p{L}\\p{N} ]", ".")
    for plain, variants in _VARIANTS.items():
        out = F.regexp_replace(out, plain, f"[{variants}]")
    return F.concat(F.lit("(?iU)(?<![\\w])"), F.regexp_replace(out, " +", "\\\\s+"), F.lit("(?![\\w])"))


def _valid(kind: str | None, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "iban":
        return tx.iban_valid(F.regexp_replace(x, "[\\s\\-.]", ""))
    return {"luhn": tx.luhn_valid, "tckn": tx.tckn_valid}[kind](digits) if kind else F.lit(True)


def _checked(found: Column, check: str | None) -> Column:
    return F.filter(found, lambda x: _valid(check, x)) if check else found


def _replaced(df: DataFrame, kind: str, found: Column, *, words: bool = False) -> DataFrame:
    """Replaces the found originals by numbered placeholders of a kind; equal originals share one. With ``words`` only where they are no part of a word.

    The numbers of one call are equally long, and longer than any behind the kind's name in the text itself, so that no
    placeholder is the beginning of another or stands in the text already. ``tokens`` are in order of replacement.
    """
    df = df.withColumn("_found", F.array_except(F.array_distinct(found), F.transform("tokens", lambda t: t["original"])))
    have = F.size(F.filter("tokens", lambda t: t["kind"] == kind))
    there = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.col("_raw"), F.lit(f"{kind}_([0-9]+)"), F.lit(1)), F.length)), F.lit(0))
    width = F.greatest(F.length((have + F.size("_found")).cast("string")), F.when(F.col("_raw").contains(f"{kind}_"), there + 1).otherwise(1))
    df = df.withColumn("_width", width)
    number = lambda i: F.lpad((have + i + 1).cast("string"), F.col("_width"), F.lit("0"))
    fresh = F.transform("_found", lambda o, i: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}_"), number(i), F.when(F.lit(kind) == "IBAN", F.concat(F.lit("_…"), F.right(F.regexp_replace(o, "[\\s\\-.]", ""), F.lit(4)))).otherwise("")).alias("token"), o.alias("original")))
    # longer originals first, so that none is cut out of another
    order = F.transform(F.array_sort(F.transform(fresh, lambda t: F.struct((-F.length(t["original"])).alias("n"), t.alias("t")))), lambda x: x["t"])
    df = df.withColumn("_fresh", order)
    quoted = lambda x: F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?!\\w)"))
    put = lambda a, t: F.regexp_replace(a, quoted(t["original"]), t["token"]) if words else F.replace(a, t["original"], t["token"])
    text = F.aggregate("_fresh", F.col("redacted"), put)
    return df.withColumn("redacted", text).withColumn("tokens", F.concat("tokens", "_fresh")).drop("_found", "_fresh", "_width")


def pseudonymised(df: DataFrame, text: str = "text", names: str | None = None) -> DataFrame:
    """Adds ``redacted`` and ``tokens`` (kind, token, original), by which :func:`restored` gives the text back.

    Numbers of accounts, cards, persons and phones, addresses, the row's own
    ``names`` (an array) in any case and marks, and first names with a surname
    are replaced. Placeholders are numbered within the row. A null text stays null.
    """
    tokens = F.array().cast("array<struct<kind:string,token:string,original:string>>")
    df = df.withColumn("redacted", F.col(text)).withColumn("_raw", F.col(text)).withColumn("tokens", tokens)
    for kind, pattern, check in PATTERNS:
        found = F.coalesce(F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        df = _replaced(df, kind, _checked(found, check))
    if names:
        known = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(F.trim(n)) >= 3)
        spots = F.flatten(F.transform(known, lambda n: F.regexp_extract_all("redacted", _name_pattern(n), F.lit(0))))
        df = _replaced(df, "MUSTERI", F.coalesce(spots, F.array().cast("array<string>")), words=True)
    people = F.coalesce(F.regexp_extract_all("redacted", F.lit(person_pattern()), F.lit(0)), F.array().cast("array<string>"))
    return _replaced(df, "KISI", people).drop("_raw")


def restored(text: Column, tokens: Column) -> Column:
    """The text with its placeholders replaced by what they stand for, the last one put in first."""
    return F.aggregate(F.reverse(tokens), text, lambda a, t: F.replace(a, t["token"], t["original"]))


#: Stands between the fields of an object while they are redacted together.
FIELD = "\u0001"


def pseudonymised_fields(df: DataFrame, fields: Sequence[str], names: str | None = None) -> DataFrame:
    """The string columns ``fields`` redacted as one object: an original has one placeholder in all of them. Adds ``tokens``."""
    whole = df.withColumn("_whole", F.array_join(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)), FIELD))
    out = pseudonymised(whole, "_whole", names)
    parts = F.split("redacted", FIELD)
    return out.withColumns({f: F.when(F.col(f).isNotNull(), F.get(parts, i)) for i, f in enumerate(fields)}).drop("_whole", "redacted")


def restored_streams(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Streams (stream, seq, chunk) put together and restored, so that a placeholder cut between chunks is whole again."""
    whole = chunks.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("text"))
    return whole.join(tokens, "stream").select("stream", restored(F.col("text"), F.col("tokens")).alias("text"))


# --- descriptions -----------------------------------------------------------------------------
# Names of amounts up to a limit, and of hours.
AMOUNT_BANDS = ((500, "çok küçük"), (2_500, "küçük"), (10_000, "orta"), (50_000, "büyük"))
HOUR_BANDS = ((6, "gece"), (12, "sabah"), (18, "öğleden sonra"))


def _band(x: Column, bands: Sequence[tuple[int, str]], last: str) -> Column:
    out = F.when(x < bands[0][0], bands[0][1])
    for limit, name in bands[1:]:
        out = out.when(x < limit, name)
    return out.otherwise(last)


def amount_band(amount: Column) -> Column:
    return _band(amount, AMOUNT_BANDS, "çok büyük")


def hour_band(hour: Column) -> Column:
    return F.when(hour.isNull(), "bilinmeyen saat").otherwise(_band(hour, HOUR_BANDS, "akşam"))


def transaction_document(amount: Column, device: Column, location: Column, channel: Column, hour: Column) -> Column:
    """A payment as a sentence about behaviour, without its number and time."""
    t = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Müşteri "), amount_band(amount), F.lit(" tutarlı ("), F.format_string("%.0f", amount), F.lit(" TRY) işlem yapar. Cihaz: "), t(device), F.lit(". Lokasyon: "), t(location), F.lit(". Kanal: "), t(channel), F.lit(". Saat bandı: "), hour_band(hour), F.lit("."))


def behaviour_document(average: Column, devices: Column, locations: Column, hours: Column) -> Column:
    """What a customer usually does, as sentences; bands of hours in order of their names."""
    bands = F.array_sort(F.array_distinct(F.transform(hours, hour_band)))
    return F.concat(F.lit("Müşteri genellikle "), amount_band(average), F.lit(" tutarlı (ortalama "), F.format_string("%.2f", average), F.lit(" TRY) işlem yapar. Cihazlar: "), F.array_join(devices, ", "), F.lit(". Lokasyonlar: "), F.array_join(locations, ", "), F.lit(". Saat bandı: "), F.array_join(bands, ", "), F.lit("."))


# --- embeddings -------------------------------------------------------------------------------
DIM = 256


@F.pandas_udf(T.ArrayType(T.LongType()))
def _counts(words: pd.Series) -> pd.Series:
    """Signed counts of a row's words (parted by spaces) by slot."""
    from collections import Counter
    from hashlib import blake2b

    slots: dict[str, tuple[int, int]] = {}

    def of(w: str) -> tuple[int, int]:
        if w not in slots:
            d = blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            slots[w] = (int.from_bytes(d[:4], "little") % DIM, 1 if d[4] & 1 else -1)
        return slots[w]

    def one(t: str | None) -> list[int]:
        out = [0] * DIM
        for w, n in Counter((t or "").split(" ")).items():
            if w:
                slot, sign = of(w)
                out[slot] += sign * n
        return out

    return words.map(one)


def _unit(counts: Column) -> Column:
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(F.transform(F.array(F.struct(counts.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0))), 0)


def _word_counts(text: Column) -> Column:
    return _counts(F.array_join(F.regexp_extract_all(F.lower(text), F.lit("(?U)\\w+"), F.lit(0)), " "))


def with_embedding(docs: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """Adds the hashed embedding of each row's own text: no row is shuffled. Null has a zero vector."""
    return docs.withColumn("_v", _word_counts(F.col(text))).withColumn(name, _unit(F.col("_v"))).drop("_v")


def hash_embedding(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, embedding: signed counts of a text's words in 256 slots, scaled to length 1.

    Texts of one key count together; a text without words is all zeros. Where keys are
    distinct :func:`with_embedding` gives the same without a shuffle.
    """
    each = docs.select(key, _word_counts(F.when(F.col(key).isNotNull(), F.col(text))).alias("_v"))
    add = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.aggregate("_all", F.lit(0).cast("long"), lambda a, v: a + F.get(v, i)))
    return each.groupBy(key).agg(F.collect_list("_v").alias("_all")).select(key, add.alias("_v")).select(key, _unit(F.col("_v")).alias("embedding"))


def unknown_citations(text: Column, allowed: Column, pattern: str = "\\b(?:CASE|TX)-\\d+\\b") -> Column:
    """Evidence numbers that a text cites and the dossier does not hold, in order of their names."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), allowed))
