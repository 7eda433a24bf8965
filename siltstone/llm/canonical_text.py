"""One consistent form for text that looks the same but differs in its characters.

A transducer is compiled from the rules for invisible characters, widths and other compatibility forms,
accents, spaces and look-alike letters. It reads a text once, cluster by cluster (a character with the
marks that follow it, invisible characters in between included; the letters of a Hangul syllable), and writes
each cluster's canonical form: single characters and characters with one mark out of compiled tables, the rest
put together from them; within a cluster the longest entry of the look-alike table wins. Characters whose rules
disagree are found when it is compiled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import stored

#: Characters that don't count (fixed values).
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Look-alike tables above this size are refused: the table is compiled on the driver and sent to every task.
MOST_GLYPHS = 200_000
#: Clusters whose outputs a task remembers.
MEMORY = 1 << 16


class Conflict(ValueError):
    """Two rules give one character different forms."""


class Transducer:
    """Canonical form of texts; picklable, compiled from (glyph, ascii) pairs."""

    def __init__(self, pairs: list[tuple[str, str]]):
        table: dict[str, str] = {}
        for glyph, letter in pairs:
            if not glyph or letter is None:
                continue
            self._check(glyph, letter)
            key, value = unicodedata.normalize("NFKD", glyph), unicodedata.normalize("NFKD", letter)
            if table.setdefault(key, value) != value:
                raise Conflict(f"{glyph!r} stands for {table[key]!r} and {value!r}")
        for key, value in table.items():  # a look-alike of a look-alike: follow it to its end
            seen = {key}
            while value in table and value not in seen:
                seen.add(value)
                value = table[value]
            if value in seen and value != key:
                raise Conflict(f"{key!r} stands for itself in a circle")
            table[key] = value
        table = {k: v for k, v in table.items() if k != v}
        self.table = table
        self.longest = max(map(len, table), default=1)
        self.plain_ascii = not any(k.isascii() for k in table)
        self.single = self._compile()
        own = lambda f: "".join(sorted(chr(p) for p in self.single if f(unicodedata.normalize("NFKD", chr(p)))))
        self.joining = own(lambda d: unicodedata.combining(d[0])) if self.single else ""
        self.joining = "".join(c for c in self.joining if unicodedata.category(c)[0] != "M")
        self.jamo = own(lambda d: d and ("\u1100" <= d[0] <= "\u11ff" or "\u1100" <= d[-1] <= "\u11ff"))
        self.pairs = self._compile_pairs()
        self._start()

    @staticmethod
    def _check(glyph: str, letter: str) -> None:
        """Look-alikes must not contradict the other rules: what is invisible, a space, or a variant of an ASCII character
        cannot stand for another one."""
        plain = unicodedata.normalize("NFKD", glyph)
        for c in glyph:
            if c in INVISIBLE or (unicodedata.category(c) == "Zs" and len(glyph) == 1):
                raise Conflict(f"{glyph!r} is {'invisible' if c in INVISIBLE else 'a space'} and stands for {letter!r}")
        if not glyph.isascii() and plain.isascii() and plain != unicodedata.normalize("NFKD", letter):
            raise Conflict(f"{glyph!r} is a variant of {plain!r} and stands for {letter!r}")

    def _compile(self) -> dict[int, str]:
        """The canonical form of every single character that has another one."""
        found = {}
        for point in range(0x80, sys.maxunicode + 1):
            if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
                continue  # Hangul syllables are their own form; surrogates are no characters
            char = chr(point)
            if char in INVISIBLE or unicodedata.category(char) == "Zs" or unicodedata.decomposition(char) or char in self.table:
                form = self._form(char)
                if form != char:
                    found[point] = form
        return found

    def _compile_pairs(self) -> dict[str, str]:
        """The canonical form of every character with one mark that has a composed form: the character itself and all
        that have it for their form."""
        variants: dict[str, list[str]] = {}
        for point, form in self.single.items():
            if len(form) == 1:
                variants.setdefault(form, []).append(chr(point))
        found = {}
        for point in range(0xC0, sys.maxunicode + 1):
            parts = unicodedata.decomposition(chr(point)).split() if not 0xAC00 <= point <= 0xD7A3 else []
            if len(parts) == 2 and not parts[0].startswith("<"):
                base, mark = (chr(int(x, 16)) for x in parts)
                for same in (base, *variants.get(base, ())):
                    found[same + mark] = self._form(same + mark)
        return found

    def _form(self, cluster: str) -> str:
        points = unicodedata.normalize("NFKD", "".join(" " if unicodedata.category(c) == "Zs" else c for c in cluster if c not in INVISIBLE))
        if not any(c in INVISIBLE for c in points):
            out, i = [], 0
            while i < len(points):
                for n in range(min(self.longest, len(points) - i), 0, -1):
                    if (to := self.table.get(points[i : i + n])) is not None:
                        out.append(to)
                        i += n
                        break
                else:
                    out.append(points[i])
                    i += 1
            return unicodedata.normalize("NFC", "".join(out))
        return self._form(points)

    def _start(self) -> None:
        self._memory: dict[str, str] = {}
        marks = rf"[\p{{M}}{INVISIBLE}{self.joining}]"
        jamo = f"[ᄀ-ᇿ가-힣{self.jamo}]"
        several = rf"{jamo}(?:{jamo}|{marks})*|[^{marks[1:]}?{marks}+"
        self._clusters = regex.compile(several if self.plain_ascii else rf"{several}|[\x00-\x7f]")
        self._several = regex.compile(rf"{jamo}|{marks}").search if self.plain_ascii else lambda text: True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memory", "_clusters", "_several")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def _written(self, cluster: str) -> str:
        found = self.pairs.get(cluster) or self._memory.get(cluster)
        if found is None:
            if len(self._memory) >= MEMORY:
                self._memory.clear()
            found = self._memory[cluster] = self._form(cluster)
        return found

    def __call__(self, text: str) -> str:
        if self.plain_ascii and text.isascii():
            return text
        if not self._several(text):  # every cluster is one character
            return text.translate(self.single)
        out, at = [], 0
        for m in self._clusters.finditer(text):
            out += (text[at : m.start()].translate(self.single), self._written(m[0]))
            at = m.end()
        return "".join([*out, text[at:].translate(self.single)])


def compiled(confusable: DataFrame) -> Transducer:
    """The transducer of a look-alike table (glyph, ascii_char), whose size is checked first."""
    rows = confusable.select("glyph", "ascii_char").filter(F.col("glyph").isNotNull() & F.col("ascii_char").isNotNull()).limit(MOST_GLYPHS + 1).collect()
    if len(rows) > MOST_GLYPHS:
        raise ValueError(f"a look-alike table may have at most {MOST_GLYPHS} glyphs")
    return Transducer(sorted((r[0], r[1]) for r in rows))


def canonical(column: Column, transducer: Transducer) -> Column:
    """The canonical form of a text column. Plain ASCII texts stay in the JVM; null stays null."""

    @F.arrow_udf("string")
    def written(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else transducer(t) for t in texts.to_pylist()], pa.string())

    if not transducer.plain_ascii:
        return written(column)
    ascii_only = column.rlike(r"^[\x00-\x7F]*+\z")
    return F.when(ascii_only, column).otherwise(written(F.when(~ascii_only, column)))


def canonical_strings(strings: DataFrame, confusable: DataFrame) -> DataFrame:
    """(string_id, artifact_sha256, raw_string, canonical): one row per row; null stays null, empty stays empty."""
    return strings.select("string_id", "artifact_sha256", "raw_string", canonical(F.col("raw_string"), compiled(confusable)).alias("canonical"))


def _forms(strings: DataFrame, confusable: DataFrame) -> DataFrame:
    """(string_id, form, said, other), written: digests of (artifact, canonical form) and of the text, and whether they
    differ; rows without id, artifact or text are left out."""
    some = strings.filter(F.col("string_id").isNotNull() & F.col("artifact_sha256").isNotNull() & F.col("raw_string").isNotNull())
    key = F.unhex(F.md5(F.concat(F.col("artifact_sha256"), F.lit("\u0001"), F.col("canonical"))))
    forms = canonical_strings(some, confusable)
    return stored(forms.select("string_id", key.alias("form"), F.unhex(F.md5("raw_string")).alias("said"), (F.col("raw_string") != F.col("canonical")).alias("other")), "text-forms")


def form_members(strings: DataFrame, confusable: DataFrame) -> DataFrame:
    """(string_id, form, said, links): the form class and the text of every row, and how many rows of the class have
    another text. No pair is expanded: a class is counted by its texts first."""
    rows = _forms(strings, confusable)
    texts = rows.groupBy("form", "said").agg(F.count("*").alias("n"))
    whole = texts.groupBy("form").agg(F.sum("n").alias("all"), F.count("*").alias("texts")).filter("texts > 1")
    links = stored(texts.join(whole, "form").select("form", "said", (F.col("all") - F.col("n")).alias("links")), "form-links")
    found = rows.select("string_id", "form", "said").join(links, ["form", "said"], "left")
    return found.select("string_id", F.lower(F.hex("form")).alias("form"), F.lower(F.hex("said")).alias("said"), F.coalesce("links", F.lit(0)).alias("links"))


def lookalikes(strings: DataFrame, confusable: DataFrame) -> DataFrame:
    """(string_id_a, string_id_b): rows of one artifact, the smaller id first, that differ and read the same.

    Rows are compared by 128-bit digests of their text and of (artifact, canonical form), so no text is
    shuffled. The distinct texts of a form are paired first, one row each however often they occur; only then
    are the rows of two different texts put together. Null texts, ids and artifacts pair with nothing.
    """
    rows = _forms(strings, confusable)
    texts = rows.groupBy("form", "said").agg(F.max("other").alias("other"))
    mixed = rows.filter("other").select("form").distinct()
    texts = stored(texts.join(mixed, "form", "left_semi"), "form-texts")
    a, b = texts.select("form", F.col("said").alias("said_a")), texts.select("form", F.col("said").alias("said_b"))
    pairs = a.join(b, "form").filter(F.col("said_a") < F.col("said_b"))
    ids = rows.select("form", "said", "string_id").join(texts.select("form", "said"), ["form", "said"], "left_semi")
    met = pairs.join(ids.withColumnsRenamed({"said": "said_a", "string_id": "x"}), ["form", "said_a"]).join(ids.withColumnsRenamed({"said": "said_b", "string_id": "y"}), ["form", "said_b"])
    return met.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("string_id_a"), F.greatest("x", "y").alias("string_id_b")).distinct()
