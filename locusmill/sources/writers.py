"""Writers: delimited results, VCF text, PLINK binary, matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import marker_stats


def write_results(df: DataFrame, path: str, order: tuple[str, ...] = ("contig", "beg"), gzip: bool = True) -> None:
    """A tab-separated table with header, ordered over files by range."""
    have = [c for c in order if c in df.columns]
    out = df.orderBy(*have) if have else df
    out.write.option("sep", "\t").option("header", True).option("nullValue", "NA").option("compression", "gzip" if gzip else "none").csv(path)


def genotype_text(g: Column, digits: int = 3) -> Column:
    """A dosage as text: an integer where it is one, else with digits decimals, NA where missing."""
    return F.when(g.isNull(), "NA").when(g == F.floor(g), g.cast("int").cast("string")).otherwise(F.format_number(g, digits))


def matrix_lines(variants: DataFrame, name: str = "id") -> DataFrame:
    """One line a marker: its name and its genotypes, tab-separated."""
    return variants.select(F.concat_ws("\t", F.col(name), F.array_join(F.transform("g", lambda x: genotype_text(x)), "\t")).alias("value"))


def vcf_lines(variants: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """VCF lines of variants with AC, AN, NS and AF of their calls put in front of INFO (needs contig, pos, id, ref, alt, g)."""
    s = marker_stats(F.col("g"))
    info = F.concat(F.lit("AC="), F.round(s["ac"]).cast("long").cast("string"), F.lit(";AN="), s["an"].cast("string"), F.lit(";NS="), s["ns"].cast("string"), F.lit(";AF="), F.coalesce(F.format_string("%.6f", s["af"]), F.lit(".")))
    call = lambda x: F.when(x.isNull(), "./.").when(x < 0.5, "0/0").when(x < 1.5, "0/1").otherwise("1/1")
    have = variants.columns
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in have else F.lit(".")
    return variants.select(F.concat_ws("\t", *[text(c) for c in ("contig", "pos", "id", "ref", "alt", "qual", "filter")], info, F.lit("GT"), F.array_join(F.transform("g", call), "\t")).alias("value"))


def vcf_header(samples: list[str]) -> str:
    return "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])


PLINK_MAGIC = bytes([0x6C, 0x1B, 0x01])


def plink_rows(variants: DataFrame) -> DataFrame:
    """contig, id, pos, alt, ref and packed: two bits a call (hom. alternate 00, missing 01, het. 10, hom. reference 11), four calls a byte."""

    def run(batches):
        for part in batches:
            packed = []
            for g in part["g"]:
                v = np.array([np.nan if x is None else x for x in g], float)
                code = np.select([np.isnan(v), v >= 1.5, v >= 0.5], [1, 0, 2], 3).astype(np.uint8)
                code = np.pad(code, (0, -len(code) % 4)).reshape(-1, 4)
                packed.append((code << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
            yield part[["contig", "id", "pos", "alt", "ref"]].assign(packed=packed)

    return variants.select("contig", "id", "pos", "alt", "ref", "g").mapInPandas(run, "contig string, id string, pos long, alt string, ref string, packed binary")


def unpack_plink(packed: bytes, n: int) -> list:
    """The calls of one packed marker (None: missing)."""
    b = np.frombuffer(packed, np.uint8)
    code = ((b[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[:n]
    return [[2, None, 1, 0][c] for c in code]


def fam_lines(samples: DataFrame) -> DataFrame:
    return samples.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("fam_id", "ind_id", "fat_id", "mot_id", "sex")], F.lit("-9")).alias("value"))

