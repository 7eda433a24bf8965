"""Text functions as columns; Python only where Spark has no such function, and only for the rows that need it."""

from __future__ import annotations

import binascii
import contextlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ZERO_WIDTH = r"[\u200b-\u200d\ufeff\xa0]"
DECODE_BYTES, DECODE_DEPTH, DECODED_CHARS, PRINTABLE_SHARE = 65536, 2, 4, 0.80
BASE64_TEXT, HEX_TEXT = r"[A-Za-z0-9+/=]{16,}", r"(?:[0-9a-fA-F]{2}){8,}"
#: The most letter pairs a translation may have; the table is read by the driver.
MOST_LETTERS = 200_000

NORMALIZED = "struct<normalized:string,depth:int,chain:array<string>>"


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def letter_pairs(confusable: DataFrame) -> list[tuple[str, str]]:
    """Single-character pairs of a look-alike table, in order; its size is checked."""
    rows = confusable.filter((F.length("glyph") == 1) & (F.length("ascii_char") == 1)).select("glyph", "ascii_char").limit(MOST_LETTERS + 1).collect()
    if len(rows) > MOST_LETTERS:
        raise ValueError(f"more than {MOST_LETTERS} letter pairs")
    return sorted((r[0], r[1]) for r in rows)


def resolve_letters(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_pointer(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def defang(host: Column) -> Column:
    return F.replace(host, F.lit("."), F.lit("[.]"))


def shortened(text: Column, most: int = 280) -> Column:
    """Text of at most `most` characters; a cut is marked by one more, after trailing blanks are gone."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("\u2026"))).otherwise(text)


def widened(text: Column) -> Column:
    """Text whose every second character is NUL (wide characters seen as bytes) without the NULs."""
    return F.when(text.rlike(r"^(?:[\x20-\x7E\r\n\t\xa1-\xac\xae-\xff]\x00){2,}\z"), F.replace(text, F.lit("\x00"), F.lit(""))).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty text."""
    chars = F.split(text, "")
    distinct = F.array_distinct(chars)
    n = F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(distinct, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


_packed = re.compile(rf"\s*(?:(?P<b64>{BASE64_TEXT})|(?P<hex>{HEX_TEXT}))\s*")
_invisible = re.compile("[\u200b-\u200d\ufeff\xa0]")
_hidden = re.compile(r"[^\x20-\x7e\r\n\t]")


def _unpacked(text: str) -> str | None:
    """What a text is as Base64, or else as hex; None if it is neither or too little comes out. Bytes that are no UTF-8
    are left out."""
    whole = _packed.fullmatch(text)
    if whole is None:
        return None
    inner = text.strip()
    plains = []
    if whole["b64"] and len(inner) % 4 == 0 and "=" not in inner.rstrip("=") and not inner.endswith("==="):
        with contextlib.suppress(binascii.Error):
            plains.append(binascii.a2b_base64(inner, strict_mode=True))
    if re.fullmatch(HEX_TEXT, inner):
        plains.append(binascii.unhexlify(inner))
    read = (p.decode("utf-8", "ignore") for p in plains)
    return next((p for p in read if len(p) >= DECODED_CHARS), None)


def _readable(text: str) -> bool:
    """Whether enough of a text can be seen. ASCII that can be seen is passed over first."""
    odd = _hidden.findall(text)
    unseen = len(odd) - sum(map(str.isprintable, odd))
    return len(text) - unseen >= PRINTABLE_SHARE * len(text)


def normalize_text(text: str, letters: dict[int, str]) -> tuple[str, int, list[str]]:
    """(text, depth, chain): invisible characters, compatibility forms and look-alikes resolved, then what is
    packed as Base64 or else as hex unpacked and treated alike, at most DECODE_DEPTH times."""
    chain: list[str] = []
    depth = 0
    while True:
        for step, changed in (("STRIP_ZERO_WIDTH", lambda t: _invisible.sub("", t)), ("UNICODE_NFKD", lambda t: unicodedata.normalize("NFKD", t)), ("HOMOGLYPH_RESOLVE", lambda t: t.translate(letters))):
            after = changed(text)
            if after != text:
                chain.append(step)
                text = after
        plain = _unpacked(text) if depth < DECODE_DEPTH and len(text.encode("utf-8", "surrogatepass")) <= DECODE_BYTES else None
        if plain is None or not _readable(plain):
            return text, depth, chain
        depth += 1
        chain.append(f"DECODE_RECURSIVE_D{depth}")
        text = plain


def normalized(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(normalized, depth, chain) of a text column; null stays null.

    ASCII text that cannot be packed is its own form and never leaves the JVM.
    """
    letters = {ord(a): b for a, b in pairs}
    kind = pa.struct([("normalized", pa.string()), ("depth", pa.int32()), ("chain", pa.list_(pa.string()))])

    @F.arrow_udf(NORMALIZED)
    def resolved(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            if t is None:
                rows.append(None)
            else:
                done, depth, chain = normalize_text(t, letters)
                rows.append({"normalized": done.encode("utf-8", "replace").decode(), "depth": depth, "chain": chain})
        return pa.array(rows, kind)

    plain = text.rlike(r"^[\x00-\x7F]*+\z") & ~text.rlike(rf"^\s*(?:{BASE64_TEXT}|{HEX_TEXT})\s*\z")
    own = F.struct(text.alias("normalized"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("chain"))
    return F.when(text.isNull(), F.lit(None).cast(NORMALIZED)).when(plain, own).otherwise(resolved(F.when(~plain, text)))
