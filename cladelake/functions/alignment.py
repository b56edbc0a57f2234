"""CIGAR strings, SAM flags and gap-padded alignments as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the SAM format.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}
CIGAR_TOKEN = r"(\d+)([MIDNSHP=X])"


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op); '*' has none, a string with anything between tokens raises."""
    whole = F.regexp_replace(cigar, CIGAR_TOKEN, "") == ""
    ops = F.zip_with(F.regexp_extract_all(cigar, F.lit(CIGAR_TOKEN), F.lit(1)), F.regexp_extract_all(cigar, F.lit(CIGAR_TOKEN), F.lit(2)), lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))
    return F.when(cigar == "*", F.slice(ops, 1, 0)).when(whole, ops).otherwise(F.raise_error(F.concat(F.lit("bad cigar "), cigar)))


def cigar_total(cigar: Column, kinds: str) -> Column:
    """Bases in operations of the given kinds."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.instr(F.lit(kinds), x["op"]) > 0), F.lit(0), lambda s, x: s + x["n"])


def matches(marker: Column, read: Column) -> Column:
    """Equal, ungapped places of two gap-padded strings."""
    both = F.zip_with(F.split(marker, ""), F.split(read, ""), lambda a, b: ((a == b) & (a != "-")).cast("int"))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def edge_mapped(start: Column, end: Column, marker_length: Column, legacy: bool = False) -> Column:
    """Whether a hit (0-based, end exclusive) touches an end of its marker.

    ``legacy`` compares the exclusive end with the last position, one short.
    """
    return (start == 0) | (end == (marker_length - 1 if legacy else marker_length))


def reconstruct(cigar: Column, start: Column, marker: Column, read: Column) -> Column:
    """Both strings of an alignment with gaps, clipped bases put back as far as the marker reaches.

    ``start`` is the 0-based place on the marker where the CIGAR's first
    aligned base lies; ``read`` runs along the marker and holds its clipped
    bases (hard-clipped ones as N). Returns marker_aln, read_aln and the extents
    marker_start, marker_end, read_start, read_end, ends exclusive. A skipped
    reference or a clip, pad or other operation inside the alignment raises.
    """
    ops = cigar_ops(cigar)
    clip = lambda x: F.when(F.get(x, F.lit(0))["op"] == "H", F.get(x, F.lit(0))["n"] + F.when(F.get(x, F.lit(1))["op"] == "S", F.get(x, F.lit(1))["n"]).otherwise(0)).when(F.get(x, F.lit(0))["op"] == "S", F.get(x, F.lit(0))["n"]).otherwise(0)
    lead, trail = clip(ops), clip(F.reverse(ops))
    inner = F.regexp_replace(F.regexp_replace(cigar, r"^(\d+H)?(\d+S)?", ""), r"(\d+S)?(\d+H)?$", "")
    core = F.when(inner.rlike("^([0-9]+[MID=X])+$"), cigar_ops(inner)).otherwise(F.raise_error(F.concat(F.lit("cannot align along "), cigar)))
    zero = F.struct(start.cast("int").alias("m"), lead.cast("int").alias("r"), F.lit("").alias("x"), F.lit("").alias("y"))

    def step(acc: Column, op: Column) -> Column:
        n, on_marker, on_read = op["n"], op["op"] != "I", op["op"] != "D"
        gap = F.repeat(F.lit("-"), n)
        return F.struct(
            (acc["m"] + F.when(on_marker, n).otherwise(0)).alias("m"),
            (acc["r"] + F.when(on_read, n).otherwise(0)).alias("r"),
            F.concat(acc["x"], F.when(on_marker, F.substring(marker, acc["m"] + 1, n)).otherwise(gap)).alias("x"),
            F.concat(acc["y"], F.when(on_read, F.substring(read, acc["r"] + 1, n)).otherwise(gap)).alias("y"),
        )

    body = F.aggregate(core, zero, step)
    before = F.least(lead, start)
    after = F.least(trail, F.length(marker) - body["m"])
    return F.struct(
        F.concat(F.substring(marker, start - before + 1, before), body["x"], F.substring(marker, body["m"] + 1, after)).alias("marker_aln"),
        F.concat(F.substring(read, lead - before + 1, before), body["y"], F.substring(read, body["r"] + 1, after)).alias("read_aln"),
        (start - before).alias("marker_start"),
        (body["m"] + after).alias("marker_end"),
        (lead - before).alias("read_start"),
        (body["r"] + after).alias("read_end"),
    )


def with_mate_suffix(read: Column, read_type: Column | str) -> Column:
    """Read ids of aligners that drop it, with the suffix /1 or /2 of their side; single reads stay as they are."""
    kind = F.lit(read_type) if isinstance(read_type, str) else read_type
    return F.concat(read, F.when(kind == "paired_1", "/1").when(kind == "paired_2", "/2").otherwise(""))
