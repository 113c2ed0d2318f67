"""Readers of genetic text formats into DataFrames (native expressions; gzip and block-gzip by extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import decode_gt, phase_of
from .blockgzip import read_block_lines

VCF_FIXED = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def vcf_samples(spark: SparkSession, path, blocks: bool = False) -> list[str]:
    """Names of the samples, from the first header line of the files (one row is read to the driver)."""
    row = (read_block_lines(spark, path) if blocks else _lines(spark, path)).where(F.col("value").startswith("#CHROM")).first()
    return row[0].split("\t")[9:] if row else []


def read_vcf(spark: SparkSession, path, samples: list[str] | None = None, field: str = "GT", pass_only: bool = False, region: str | None = None, max_alleles: int = 2, blocks: bool = False) -> DataFrame:
    """One row a marker: contig, pos, id, ref, alt, qual, filter, info, g (dosages, null: missing), phase, pl, file.

    With blocks, path is block-gzip and read by many tasks a file; a region then reads only
    its blocks, if write_block_index() has been there.

    field GT, PL or GL, else a number per call. Rows are filtered before their calls are split.
    samples picks and orders calls by name. Several files (one a contig) are read by one glob.
    A call whose field is absent, or starts with '.', is missing; so is a GT of which any part is.
    """
    names = vcf_samples(spark, path, blocks)
    x = read_block_lines(spark, path, region) if blocks else _lines(spark, path).withColumn("file", F.input_file_name())
    x = x.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = F.split("value", "\t", 10)
    x = x.select(*[F.get(head, i).alias(c) for i, c in enumerate(VCF_FIXED)], F.get(head, 9).alias("_calls"), "file").withColumn("pos", F.col("pos").cast("long"))
    if pass_only:
        x = x.where(F.col("filter") == "PASS")
    if region:
        from ..operators.qc import in_region

        x = in_region(x, region, "contig", "pos")
    if max_alleles == 2:
        x = x.where(~F.contains("alt", F.lit(",")))
    if not names:
        return x.drop("_calls")
    at = F.array_position(F.split("format", ":"), field)
    calls = F.split("_calls", "\t")
    if samples is not None:
        index = {n: i for i, n in enumerate(names)}
        calls = F.transform(F.array(*[F.lit(index[n]) for n in samples]), lambda i: F.get(calls, i))
    values = F.transform(calls, lambda c: F.when(at > 0, F.get(F.split(c, ":"), (at - 1).cast("int"))))
    if field == "GT":
        return x.withColumn("_v", values).select(*VCF_FIXED[:8], F.transform("_v", lambda v: decode_gt(v)).alias("g"), F.transform("_v", lambda v: phase_of(F.coalesce(v, F.lit(".")))).alias("phase"), "file")
    if field in ("PL", "GL"):
        phred = lambda v: F.transform(F.split(v, ","), lambda p: (F.when(F.lit(field == "PL"), F.least(p.try_cast("double"), F.lit(255.0))).otherwise(F.when(p.try_cast("double") < -25.5, 255.0).otherwise(F.round(-10 * p.try_cast("double"))))).cast("int"))
        return x.withColumn("_v", values).select(*VCF_FIXED[:8], F.transform("_v", lambda v: F.when(v.isNotNull() & ~v.startswith(".") & (F.size(F.split(v, ",")) == 3), phred(v))).alias("pl"), "file")
    return x.withColumn("_v", values).select(*VCF_FIXED[:8], F.transform("_v", lambda v: F.when(~v.startswith("."), v.try_cast("double"))).alias("g"), "file")


def info_value(info, key: str):
    """The value of key in an INFO text, null if absent."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def site_counts(sites: DataFrame) -> DataFrame:
    """Sites without genotypes: ac and an from INFO, and the expected sum of squares."""
    from ..functions.genotype import site_sumsq

    s = sites.withColumns({"ac": info_value("info", "AC").try_cast("double"), "an": info_value("info", "AN").try_cast("double")})
    return s.withColumn("sumsq", site_sumsq(F.col("ac"), F.col("an")))


def to_calls(variants: DataFrame, by: list[str], samples: list[str] | None = None) -> DataFrame:
    """The long view: by, sample (position or name), g."""
    x = variants.select(*by, F.posexplode("g").alias("sample", "g"))
    return x if samples is None else x.withColumn("sample", F.element_at(F.array(*[F.lit(s) for s in samples]), F.col("sample") + 1))


def read_ped(spark: SparkSession, path, dat: str | None = None, missing: str = "NA") -> DataFrame:
    """fam_id, ind_id, fat_id, mot_id, sex and one double a trait; names from a '#' header or the second words of dat.

    Without either the sixth column is PHENOTYPE. A row of another width is an error when read.
    Texts that are no numbers are missing.
    """
    lines = _lines(spark, path).where(F.trim("value") != "")
    first = lines.first()
    head = first[0] if first else ""
    if dat:
        traits = [r[0].split()[1] for r in _lines(spark, dat).where(F.trim("value") != "").collect()]  # a line a trait
    elif head.startswith("#"):
        traits = head.split()[5:]
    else:
        traits = ["PHENOTYPE"] + [f"TRAIT{i}" for i in range(2, len(head.split()) - 4)]
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#")).withColumn("w", w)
    rows = rows.withColumn("w", F.when(F.size("w") == 5 + len(traits), F.col("w")).otherwise(F.raise_error(F.concat(F.lit("a row of another width: "), F.col("value"))).cast("array<string>")))
    fixed = [F.get("w", i).alias(c) for i, c in enumerate(("fam_id", "ind_id", "fat_id", "mot_id", "sex"))]
    return rows.select(*fixed, *[F.when(F.get("w", 5 + i) != missing, F.get("w", 5 + i).try_cast("double")).alias(t) for i, t in enumerate(traits)])


def phenotypes(ped: DataFrame, traits: list[str] | None = None, covariates: list[str] | tuple[str, ...] = (), samples: DataFrame | None = None) -> DataFrame:
    """read_ped() as one row a person and trait: ind_id, the covariates, trait, y.

    Without traits they are all columns from the sixth on that aren't covariates. A name that
    isn't there, or that is both trait and covariate, is an error; so is a missing value of a
    trait or covariate when it is read, of the people in samples (ind_id) if given.
    """
    fields = ped.columns[5:]
    traits = [c for c in fields if c not in covariates] if traits is None else list(traits)
    unknown, both = [c for c in [*traits, *covariates] if c not in fields], [c for c in traits if c in covariates]
    if unknown or both or not traits:
        raise ValueError(f"not in the file: {unknown}; trait and covariate at once: {both}" if unknown or both else "no traits left")
    x = ped if samples is None else ped.join(samples.select("ind_id").distinct(), "ind_id", "left_semi")
    there = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"missing value of {c} in "), F.coalesce("ind_id", F.lit("a row without an id")))).cast("double")).alias(c)
    x = x.select("ind_id", *[there(c) for c in covariates], *[there(c) for c in traits])
    return x.unpivot(["ind_id", *covariates], traits, "trait", "y")


def read_bed(spark: SparkSession, path) -> DataFrame:
    """contig (without chr), beg (1-based), end, label (null without a fourth column)."""
    w = F.split("value", r"\s+")
    x = _lines(spark, path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    return x.select(F.regexp_replace(F.get(w, 0), "^chr", "").alias("contig"), (F.get(w, 1).cast("long") + 1).alias("beg"), F.get(w, 2).cast("long").alias("end"), F.get(w, 3).alias("label"))


# Column places of the three gene-model formats (gene, transcript, contig, strand, tx, cds, exon starts and ends).
GENE_FORMATS = {"refFlat": (0, 1, 2, 3, 4, 5, 6, 7, 9, 10), "knownGene": (0, 0, 1, 2, 3, 4, 5, 6, 8, 9), "refGene": (12, 1, 2, 3, 4, 5, 6, 7, 9, 10)}


def read_genes(spark: SparkSession, path, form: str = "refFlat") -> DataFrame:
    """gene, transcript, contig, strand, tx_start, tx_end, cds_start, cds_end (1-based, closed) and exons."""
    p = GENE_FORMATS[form]
    w = F.split("value", "\t")
    numbers = lambda i: F.transform(F.filter(F.split(F.get(w, i), ","), lambda v: v != ""), lambda v: v.cast("long"))
    exons = F.zip_with(numbers(p[8]), numbers(p[9]), lambda a, b: F.struct((a + 1).alias("beg"), b.alias("end")))
    x = _lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    n = lambda i, add=0: F.get(w, p[i]).cast("long") + add
    return x.select(F.get(w, p[0]).alias("gene"), F.get(w, p[1]).alias("transcript"), F.regexp_replace(F.get(w, p[2]), "^chr", "").alias("contig"), F.get(w, p[3]).alias("strand"), n(4, 1).alias("tx_start"), n(5).alias("tx_end"), n(6, 1).alias("cds_start"), n(7).alias("cds_end"), exons.alias("exons"))


def read_results(spark: SparkSession, path) -> DataFrame:
    """A tab-separated result table with a header (a leading # is dropped); NA is null, numbers stay text until cast by name."""
    x = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    return x.toDF(*[c.lstrip("#") for c in x.columns])


def read_groups(spark: SparkSession, path) -> DataFrame:
    """grp, marker: one row a marker of each line 'group<TAB>marker...'."""
    w = F.split("value", r"\s+")
    return _lines(spark, path).where(F.trim("value") != "").select(F.get(w, 0).alias("grp"), F.explode(F.slice(w, 2, 1 << 30)).alias("marker"))


def read_map(spark: SparkSession, path) -> DataFrame:
    """contig, at, rate, cm of a genetic map with a header."""
    w = F.split("value", r"\s+")
    return _lines(spark, path).select(F.regexp_replace(F.get(w, 0), "^chr", "").alias("contig"), F.get(w, 1).try_cast("long").alias("at"), F.get(w, 2).try_cast("double").alias("rate"), F.get(w, 3).try_cast("double").alias("cm")).where("at is not null")


def read_annotator_input(spark: SparkSession, path, form: str = "vcf") -> DataFrame:
    """contig, pos, ref, alt, line of vcf, plain (contig pos ref alt), plink (assoc: A1 alt, A2 ref) or result tables (MARKER_ID)."""
    w = F.split(F.trim("value"), r"\s+")
    x = _lines(spark, path).where(~F.col("value").rlike(r"^(#|\s*$|\s*CHR\s)"))
    at = {"vcf": (0, 1, 3, 4), "plain": (0, 1, 2, 3), "plink": (0, 2, 6, 3)}
    if form in at:
        a, b, c, d = at[form]
        return x.select(F.regexp_replace(F.get(w, a), "^chr", "").alias("contig"), F.get(w, b).cast("long").alias("pos"), F.get(w, c).alias("ref"), F.get(w, d).alias("alt"), F.col("value").alias("line"))
    from ..model import parse_marker_id

    m = parse_marker_id(F.get(w, 3))
    return x.select(m["contig"].alias("contig"), m["beg"].alias("pos"), m["ref"].alias("ref"), m["alt"].alias("alt"), F.col("value").alias("line"))


def read_fasta(spark: SparkSession, path, chunk: int = 10_000) -> DataFrame:
    """contig, chunk, seq: the reference in pieces of chunk bases, for lookups by an equal join.

    A file a contig spreads over tasks by file; each task streams its text in order.
    """
    import pandas as pd

    def run(batches):
        for part in batches:
            for data in part["content"]:
                for record in bytes(data).decode("ascii").split(">")[1:]:
                    name, _, body = record.partition("\n")
                    seq = body.replace("\n", "").replace("\r", "").upper()
                    yield pd.DataFrame({"contig": name.split()[0].removeprefix("chr"), "chunk": range(0, (len(seq) + chunk - 1) // chunk), "seq": [seq[i : i + chunk] for i in range(0, len(seq), chunk)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "contig string, chunk long, seq string")


def bases_at(points: DataFrame, fasta: DataFrame, pos: str = "pos", length: str | None = None, out: str = "base", chunk: int = 10_000) -> DataFrame:
    """points with the reference bases from pos on (one, or the number in column length), gathered from the chunks they touch."""
    n = F.col(length) if length else F.lit(1)
    keys = points.withColumn("_id", F.struct("contig", pos, n.alias("n")))
    ids = keys.select("_id").distinct()
    spans = ids.select("_id", F.explode(F.sequence(F.floor((F.col(f"_id.{pos}") - 1) / chunk), F.floor((F.col(f"_id.{pos}") + F.col("_id.n") - 2) / chunk))).alias("chunk"), F.col("_id.contig").alias("contig"))
    got = spans.join(fasta, ["contig", "chunk"]).groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda s: s["seq"]), "").alias("_s"), F.min("chunk").alias("_c"))
    start = (F.col(f"_id.{pos}") - F.col("_c") * chunk).cast("int")
    got = got.select("_id", F.substring(F.col("_s"), start, F.col("_id.n").cast("int")).alias(out))
    return keys.join(got, "_id", "left").drop("_id")


def check_reference(variants: DataFrame, fasta: DataFrame, chunk: int = 10_000) -> DataFrame:
    """variants with ref_ok, and ref and alt swapped where only alt agrees with the reference (swapped)."""
    v = bases_at(variants.withColumn("_n", F.greatest(F.length("ref"), F.length("alt"))), fasta, length="_n", out="_seq", chunk=chunk)
    ok, other = F.col("_seq").startswith(F.upper("ref")), F.col("_seq").startswith(F.upper("alt"))
    v = v.withColumns({"ref_ok": F.coalesce(ok | other, F.lit(False)), "swapped": F.coalesce(~ok & other, F.lit(False))})
    return v.withColumns({"ref": F.when(F.col("swapped"), F.col("alt")).otherwise(F.col("ref")), "alt": F.when(F.col("swapped"), F.col("ref")).otherwise(F.col("alt"))}).drop("_n", "_seq")


def read_score_track(spark: SparkSession, path, contig: str) -> DataFrame:
    """contig, pos, score of a file of 32-bit floats, one a base."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for part in batches:
            for data in part["content"]:
                x = np.frombuffer(bytes(data), "<f4")
                for a in range(0, len(x), 1 << 18):
                    yield pd.DataFrame({"contig": contig, "pos": np.arange(a + 1, min(a + (1 << 18), len(x)) + 1), "score": x[a : a + (1 << 18)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "contig string, pos long, score float")
