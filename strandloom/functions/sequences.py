"""Column functions on headers, sequences, words and vectors. All are built-in expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The read header of one sequencer family, and the complement.
READ_NAME = r"^\S+\s+(?:\S+\s+)*?([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?=\s|$)"
BASES, COMPLEMENT = "ACGT", "TGCA"
RANKS = ("domain", "supergroup", "division", "subdivision", "class", "order", "family", "genus", "species")
CORE_PRIMER = "GGGCACCACAAGAACG"  # reads begin two bases before it
TAXONOMY_HINT = r"(?i)\b(tax(on|onomy)?[_:=]|taxid|kraken|species|genus|family|phylum|superkingdom|sk__|k__|p__|c__|o__|f__|g__|s__|OTU|ASV|lineage)\b"
LABEL_SUFFIXES = (".tsv", ".csv", ".txt", ".taxonomy", ".tax", ".json")


def round_to(x: Column, digits: int = 6) -> Column:
    """Half up by way of floor, which gives the same double in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row. A filter on a plain projection is pushed below it with copies of what it
    uses, nested ones many times over; none is pushed below a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


# ---- headers


def seq_id(header: Column) -> Column:
    return F.coalesce(F.split(F.trim(header), r"\s+")[0], F.lit(""))


def description(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S+\s+(.*)$", 1)


def accession(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"\.[^.]*$", "")


def header_fields(header: Column) -> dict[str, Column]:
    """The named fields of a header, null where it does not have them."""
    text = lambda i: F.nullif(F.regexp_extract(header, READ_NAME, i), F.lit(""))
    out = {"instrument": text(1), "flowcell": text(3)}
    out |= {name: text(i).try_cast("int") for name, i in (("lane", 4), ("tile", 5), ("x", 6), ("y", 7))}
    return out | {"declared_length": F.nullif(F.regexp_extract(header, r"\blength=(\d+)\b", 1), F.lit("")).try_cast("int")}


# ---- sequences


def count_char(seq: Column, chars: str) -> Column:
    """How many characters of seq are among chars, by a replacement of each."""
    rest = seq
    for c in dict.fromkeys(chars):
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(seq) - F.length(rest)).cast("int")


def gc_content(seq: Column) -> Column:
    """Over A, C, G and T alone; 0 without any."""
    gc, at = count_char(seq, "GC"), count_char(seq, "AT")
    return F.when(gc + at > 0, gc / (gc + at)).otherwise(F.lit(0.0))


def longest_run(seq: Column, alphabet: str = BASES) -> Column:
    """The first longest run of characters of the alphabet."""
    runs = F.regexp_extract_all(seq, F.lit(f"([{alphabet}]+)"), F.lit(1))
    return F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def trim_ends(seq: Column, alphabet: str = BASES) -> Column:
    return F.regexp_replace(seq, f"^[^{alphabet}]+|[^{alphabet}]+$", "")


def positions_of(seq: Column, chars: str) -> Column:
    """0-based positions of the characters among chars."""
    every = F.transform(F.split(seq, ""), lambda c, i: F.when((c != '') & F.lit(chars).contains(c), i))
    return F.filter(every, lambda i: i.isNotNull())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of A, C, G and T, in order."""
    n = F.length(seq) - F.lit(k) + 1
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= 1, F.filter(every, lambda w: ~w.rlike("[^ACGT]"))).otherwise(F.array().cast("array<string>"))


def word_set(seq: Column, k: int) -> Column:
    return F.array_sort(F.array_distinct(kmers(seq, k)))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ."""
    apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.aggregate(apart, F.lit(0), lambda s, x: s + x)


def pcr_window(seq: Column, core: str, length: int, back: int = 2) -> Column:
    """From `back` bases before the first occurrence of core on; null without one. U reads as T."""
    s = F.translate(F.upper(seq), "U", "T")
    at = F.instr(s, F.lit(core))
    return F.when(at > 0, F.substring(s, F.greatest(at - F.lit(back), F.lit(1)), F.lit(length)))


def lineage(path: Column) -> dict[str, Column]:
    """The ranks of a `;`-separated lineage; missing ones are empty."""
    parts = F.filter(F.split(path, ";"), lambda x: x != "")
    return {rank: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")) for i, rank in enumerate(RANKS)}


# ---- vectors


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def hash_draw(text: Column) -> Column:
    """A portable draw of 60 bits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
