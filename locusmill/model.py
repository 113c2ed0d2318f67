"""Shared constants and the text form of markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRCh37 contigs and their lengths.
CONTIGS = {
    "1": 249250621, "2": 243199373, "3": 198022430, "4": 191154276, "5": 180915260, "6": 171115067, "7": 159138663, "8": 146364022, "9": 141213431, "10": 135534747, "11": 135006516,
    "12": 133851895, "13": 115169878, "14": 107349540, "15": 102531392, "16": 90354753, "17": 81195210, "18": 78077248, "19": 59128983, "20": 63025520, "21": 48129895, "22": 51304566,
    "X": 155270560, "Y": 59373566, "MT": 16569,
}
AUTOSOMES = [str(i) for i in range(1, 23)]
#: Regions of long-range linkage that kinship leaves out (contig, first, last base).
COMPLEX_REGIONS = [("5", 44000001, 51500000), ("6", 24000001, 36000000), ("8", 8000001, 12000000), ("11", 42000001, 58000000), ("17", 40000001, 43000000)]


def _contig_map(values) -> Column:
    return F.create_map(*[F.lit(x) for kv in values for x in kv])


def contig_number(contig: Column) -> Column:
    """1..22, X 23, Y 24, MT 25, null for others; a leading 'chr' is dropped."""
    return F.element_at(_contig_map([(c, i + 1) for i, c in enumerate(CONTIGS)]), F.regexp_replace(contig, "^chr", ""))


def linear_position(contig: Column, pos: Column) -> Column:
    """A position on the whole genome: lengths of all contigs before, plus pos."""
    total, offsets = 0, []
    for c, n in CONTIGS.items():
        offsets.append((c, total))
        total += n
    return F.element_at(_contig_map(offsets), F.regexp_replace(contig, "^chr", "")).cast("long") + pos.cast("long")


def contig_end(contig: Column) -> Column:
    return F.element_at(_contig_map(list(CONTIGS.items())), contig)


def marker_id(contig: Column, pos: Column, ref: Column, alt: Column, name: Column | None = None, anno: Column | None = None) -> Column:
    """CHR:POS[-END]_REF/ALT[_ID][_ANNO]; END only where the reference has several bases."""
    end = F.when(F.length(ref) > 1, F.concat(F.lit("-"), (pos + F.length(ref) - 1).cast("string"))).otherwise(F.lit(""))
    tail = [F.coalesce(F.concat(F.lit("_"), x), F.lit("")) for x in (name, anno) if x is not None]
    return F.concat(contig, F.lit(":"), pos.cast("string"), end, F.lit("_"), ref, F.lit("/"), alt, *tail)


def parse_marker_id(col: Column) -> Column:
    """struct(contig, beg, end, ref, alt, rest) of a marker's text form; null parts where it has another form."""
    p = r"^(?:chr)?([^:]+):(\d+)(?:-(\d+))?(?:_([^/_]+)/([^_]+))?(?:_(.*))?$"
    part = lambda i: F.nullif(F.regexp_extract(col, p, i), F.lit(""))
    beg, ref = part(2).cast("long"), part(4)
    end = F.coalesce(part(3).cast("long"), beg + F.coalesce(F.length(ref), F.lit(1)) - 1)
    return F.struct(part(1).alias("contig"), beg.alias("beg"), end.alias("end"), ref.alias("ref"), part(5).alias("alt"), part(6).alias("rest"))
