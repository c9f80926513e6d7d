"""Columns that read and write the text forms of pileups, alleles, calls and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGTNacgtn#*"


#: Indels up to this length have an expression of their own.
KNOWN_INDEL = 60


def pileup_tokens(bases: Column) -> Column:
    """The observations of a pileup string, indels with their base.

    ^ and the character after it, and $, are left out. One expression finds bases with what is inserted or deleted after
    them, with an alternative for each length; strings with longer indels are cut into pieces instead. An indel without a
    base before it is left out.
    """
    clean = F.regexp_replace(bases, r"(?s)\^.|\$", "")
    lengths = "|".join(f"{n}(?![0-9]).{{{n}}}" for n in range(1, KNOWN_INDEL + 1))
    indel = f"[+-](?:{lengths})"
    found = F.regexp_extract_all(clean, F.lit(f"(?s)([{ALPHABET}](?:{indel})?|{indel})"), F.lit(1))
    found = F.filter(found, lambda t: ~F.substring(t, 1, 1).isin("+", "-"))
    short = F.transform(found, lambda t: F.when(F.length(t) > 1, F.concat(F.substring(t, 1, 2), F.regexp_replace(F.substring(t, F.lit(3), F.length(t)), "^[0-9]+", ""))).otherwise(t))
    long = clean.rlike(rf"[+-](?:[0-9]{{3,}}|[{KNOWN_INDEL // 10 + 1}-9][0-9]|{KNOWN_INDEL // 10}[1-9])")
    return F.when(long, _tokens_by_pieces(bases)).otherwise(short)


def _tokens_by_pieces(bases: Column) -> Column:
    """The same: the string is cut before each + and -; a piece begins with an indel's sign, length and bases, which belong
    to the last base of the piece before, and the other bases stand alone."""
    clean = F.regexp_replace(bases, r"(?s)\^.|\$", "")
    pieces = F.regexp_extract_all(clean, F.lit(r"((?:^|[+-][0-9]+)[^+-]*)"), F.lit(1))

    def parsed(p: Column) -> Column:
        n = F.coalesce(F.regexp_extract(p, "^[+-]([0-9]+)", 1).try_cast("int"), F.lit(0))
        body = F.regexp_replace(p, "^[+-][0-9]+", "")
        rest = F.filter(F.split(F.substring(body, n + 1, F.length(body)), ""), lambda c: (c != "") & F.lit(ALPHABET).contains(c))
        return F.struct(rest.alias("bases"), F.when(n > 0, F.concat(F.substring(p, 1, 1), F.substring(body, F.lit(1), n))).otherwise("").alias("indel"))

    def joined(all_: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            n = F.size(p["bases"])
            last = F.concat(F.get(p["bases"], n - 1), F.coalesce(F.get(all_, k + 1)["indel"], F.lit("")))
            return F.when(n > 0, F.concat(F.slice(p["bases"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(all_, one))

    return F.get(F.transform(F.array(F.transform(pieces, parsed)), joined), 0)


def alt_info(forward: Column, reverse: Column, alleles: Column) -> Column:
    """forward/reverse-ALLELE f/r ...- of a map allele -> struct(f, r), alleles in order."""
    entries = F.array_sort(F.map_entries(alleles))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"]["f"].cast("string"), F.lit("/"), e["value"]["r"].cast("string")))
    return F.concat(forward.cast("string"), F.lit("/"), reverse.cast("string"), F.lit("-"), F.array_join(parts, " "), F.lit("-"))


def parse_alt_info(text: Column) -> Column:
    """struct(forward, reverse, alleles map allele -> struct(f, r)) of the form above."""
    depth, rest = F.substring_index(text, "-", 1), F.regexp_extract(text, r"^[^-]*-(.*)-$", 1)
    parts = F.filter(F.split(rest, " "), lambda x: x != "")
    pairs = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get(parts, 2 * i - 2).alias("k"), F.struct(F.substring_index(F.get(parts, 2 * i - 1), "/", 1).cast("int").alias("f"), F.substring_index(F.get(parts, 2 * i - 1), "/", -1).cast("int").alias("r")).alias("v")),
    )
    side = lambda k: F.substring_index(depth, "/", k).cast("int")
    return F.struct(side(1).alias("forward"), side(-1).alias("reverse"), F.map_from_entries(pairs).alias("alleles"))


def format_value(fmt: Column, sample: Column, key: str) -> Column:
    """A sample's value under a FORMAT key, or null."""
    keys = F.split(fmt, ":")
    at = F.array_position(keys, key)
    return F.when(at > 0, F.get(F.split(sample, ":"), (at - 1).cast("int")))


def with_format_value(fmt: Column, sample: Column, key: str, value: Column) -> Column:
    keys = F.split(fmt, ":")
    return F.array_join(F.transform(F.split(sample, ":"), lambda v, i: F.when(F.get(keys, i) == key, value.cast("string")).otherwise(v)), ":")


def info_value(info: Column, key: str) -> Column:
    return F.try_element_at(F.str_to_map(info, F.lit(";"), F.lit("=")), F.lit(key))


def cigar_operations(cigar: Column) -> Column:
    """array of struct(n, op, read, ref): the operations with the place in the read and on the reference before each."""
    ops = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1)),
        lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")),
    )
    start = F.struct(F.array().cast("array<struct<n:int,op:string,read:int,ref:int>>").alias("out"), F.lit(0).alias("read"), F.lit(0).alias("ref"))

    def step(s: Column, o: Column) -> Column:
        return F.struct(
            F.concat(s["out"], F.array(F.struct(o["n"].alias("n"), o["op"].alias("op"), s["read"].alias("read"), s["ref"].alias("ref")))).alias("out"),
            (s["read"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0)).alias("read"),
            (s["ref"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0)).alias("ref"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def aligned_part(cigar: Column) -> Column:
    """The part of a read's bases that M, = and X align, soft-clipped ones left out."""
    ops = cigar_operations(cigar)
    total = lambda kinds: F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*kinds), o["n"]).otherwise(0))
    return F.try_divide(total(["M", "=", "X"]), total(["M", "=", "X", "I"]))
