"""p2: texts that read the same on screen, by a skeleton of look-alike characters."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.terms import sliced
from marginalia.sources.tables import materialize

FIELDS = ("basename", "aliases", "content")
#: Letters and signs of other scripts and the Latin or ASCII prototype that each looks like.
PROTOTYPES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Armenian and others
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i",
    # Signs
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "∕": "/", "⁄": "/", "∶": ":", "։": ":", "ʼ": "’", "ˈ": "'", "‚": ",", "∗": "*",
}
#: Decompositions that change only width, typeface or ligature; raised, lowered, circled and fraction forms show.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _prototype(c: str) -> str:
    """What a character is replaced by: nothing if it doesn't show, a space if it's a space."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c in "\u034f\u115f\u1160\u3164" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    if c in ("\x85", "\u2028", "\u2029"):
        return "\n"
    if c in PROTOTYPES:
        return PROTOTYPES[c]
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in SAME_LOOK:
        return "".join(PROTOTYPES.get(x, x) for x in unicodedata.normalize("NFKD", c))
    return c


@cache
def prototypes() -> dict[int, str]:
    """The translation of every character whose prototype is another, made by the rule once a process."""
    return {n: p for n in range(0x80, sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF and (p := _prototype(chr(n))) != chr(n)}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letters and the letters that each looks like by the Unicode tables of look-alikes, of which
    Spark ships a copy in its ICU library. It is an error if that isn't there, as values that read
    the same would be missed and the result would look whole.

    Only letters that stand for letters are taken, as signs and digits that differ show, and only
    such as the rule says nothing of. ASCII letters stay apart, so ``I`` isn't ``l`` and ``m`` isn't
    ``rn``. A few thousand entries, whatever the data.
    """
    own = prototypes()
    asked = [chr(n) for n in range(0x80, 0x30000) if n not in own and unicodedata.category(chr(n))[0] == "L" and not 0xAC00 <= n <= 0xD7A3]
    try:
        builder = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder()
    except TypeError as missing:  # no such class, so its name is taken for a package
        raise RuntimeError("p2 needs com.ibm.icu.text.SpoofChecker of the ICU library (icu4j) on the driver's class path: without its tables of look-alikes, values that read the same would be missed") from missing
    told = builder.build().getSkeleton("\n".join(asked)).split("\n")
    out = {}
    for c, look in zip(asked, told, strict=True):
        look = {"rn": "m", "l": "I" if c.isupper() else "l"}.get(look, look)
        if look != unicodedata.normalize("NFD", c) and all(unicodedata.category(x)[0] in "LM" for x in look):
            out[ord(c)] = look
    return out


def with_more(more: dict[int, str]) -> dict[int, str]:
    """The rule's prototypes and more, each followed to its end."""
    return {n: p.translate(more) for n, p in (more | prototypes()).items()}


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """The text decomposed, with each character replaced by its prototype, and decomposed again.

    Two texts read the same on screen if their skeletons are equal. Width of letters, digits and
    spaces, line ends, invisible characters and the order of accents don't matter; case, accents,
    spelling and digits do. ``table`` has more prototypes than the rule.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table))


def consistent(text: str, table: dict[int, str] | None = None) -> str:
    """The skeleton in composed form, in which equal-looking values are equal."""
    return unicodedata.normalize("NFC", skeleton(text, table))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = with_more(shared.value)
        for batch in sliced(batches, *FIELDS):
            ids = batch.column("note_id").to_pylist()
            for field in FIELDS:
                out = []
                for i, text in zip(ids, batch.column(field).to_pylist(), strict=True):
                    if text and (same := skeleton(text, table)).strip():
                        key = _digest(same)
                        out.append((i, key, key if same is text else _digest(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * len(out), pa.string()), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                    ["field_name", "note_id", "key", "stored"],
                )

    return run


def classes(notes: DataFrame) -> DataFrame:
    """``(field_name, note_id, class_id, form_id, n_forms, n_notes)``: values that read as others do but are
    stored otherwise, one row for each note and field.

    Notes of one ``class_id`` read the same; those of one ``form_id`` are stored the same too.
    ``n_forms`` and ``n_notes`` are the class's. Values are reduced to 128-bit digests of skeleton
    and stored form where they are read, so texts are never shuffled, and classes of one form drop
    out. Null and blank values (nothing that shows) are in no class; repeated rows of a note count
    once; rows without a note_id are left out.
    """
    spark = notes.sparkSession
    shared = spark.sparkContext.broadcast(confusables(spark))
    schema = "field_name string, note_id bigint, key binary, stored binary"
    keys = materialize(notes.where("note_id is not null").select("note_id", *FIELDS).mapInArrow(_keys(shared), schema))
    forms = keys.groupBy("field_name", "key", "stored").agg(F.count(F.lit(1)).alias("n"))
    mixed = forms.groupBy("field_name", "key").agg(F.count(F.lit(1)).cast("int").alias("n_forms"), F.sum("n").alias("n_rows")).where("n_forms > 1")
    kept = keys.join(mixed, ["field_name", "key"]).dropDuplicates(["field_name", "note_id", "key", "stored"])
    sizes = kept.groupBy("field_name", "key").agg(F.count(F.lit(1)).alias("n_notes"))
    return kept.drop("n_rows").join(sizes, ["field_name", "key"]).select("field_name", "note_id", F.hex("key").alias("class_id"), F.hex("stored").alias("form_id"), "n_forms", "n_notes")


#: Classes of more notes than this are spread over so many parts when pairs are made.
LARGE, SALTS = 10_000, 16


def same_looking(notes: DataFrame) -> DataFrame:
    """``(field_name, note_a, note_b)``: notes whose values differ as stored but read the same.

    The classes written out as pairs: pairs of distinct stored forms of a class first, then the notes
    that hold each, so that copies of one form are never paired and the work is that of the pairs
    asked for. Large classes are spread by note. A note isn't paired with itself.
    """
    held = materialize(classes(notes))
    salts = F.when(F.col("n_notes") > LARGE, SALTS).otherwise(1)
    variants = held.select("field_name", "class_id", "form_id").distinct()
    left, right = (variants.withColumnRenamed("form_id", f"form_{s}") for s in "ab")
    pairs = left.join(right, ["field_name", "class_id"]).where("form_a < form_b")
    key = ["field_name", "class_id"]
    a = held.select(*key, F.col("form_id").alias("form_a"), F.col("note_id").alias("note_a"), F.pmod(F.xxhash64("note_id"), salts).cast("int").alias("__salt"))
    b = held.select(*key, F.col("form_id").alias("form_b"), F.col("note_id").alias("note_b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    out = a.join(pairs, [*key, "form_a"]).join(b, [*key, "form_b", "__salt"])
    return out.where("note_a <> note_b").select("field_name", F.least("note_a", "note_b").alias("note_a"), F.greatest("note_a", "note_b").alias("note_b")).distinct()


def _forms(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = with_more(shared.value)
        for batch in sliced(batches, *FIELDS):
            columns = [batch.column("note_id")]
            for field in FIELDS:
                columns.append(pa.array([None if t is None else consistent(t, table) for t in batch.column(field).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["note_id", *FIELDS])

    return run


def normalized(notes: DataFrame) -> DataFrame:
    """``(note_id, basename, aliases, content)`` in the form in which equal-looking values are equal.

    The form is for comparing, not for reading: letters of any script come out as those that they
    look like, as skeletons do. One row per row of the table; nulls stay null.
    """
    spark = notes.sparkSession
    shared = spark.sparkContext.broadcast(confusables(spark))
    return notes.select("note_id", *FIELDS).mapInArrow(_forms(shared), "note_id bigint, basename string, aliases string, content string")
