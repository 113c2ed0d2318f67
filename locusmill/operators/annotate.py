"""Functional annotation of variants against gene models, grouping by gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import range_join

# The annotation types from the most to the least severe.
PRIORITY = [
    "StructuralVariation", "Stop_Gain", "Stop_Loss", "Start_Gain", "Start_Loss", "Frameshift", "CodonGain", "CodonLoss", "CodonRegion", "Insertion", "Deletion",
    "Nonsynonymous", "Synonymous", "Essential_Splice_Site", "Normal_Splice_Site", "Utr5", "Utr3", "Exon", "Intron", "Upstream", "Downstream", "SNV", "Noncoding", "Intergenic", "Monomorphic",
]
# Other names of three types.
RENAMED = {"Stop_Gain": "Nonsense", "Nonsynonymous": "Missense", "Synonymous": "Silent"}
# What the preset for changes of the protein takes, by the form of annotation.
NONSYN = {
    "plain": ["Nonsynonymous", "Essential_Splice_Site", "Normal_Splice_Site", "Start_Loss", "Stop_Loss", "Stop_Gain"],
    "info": ["nonsynonymous", "stopgain", "stoploss", "splicing"],
    "gatk": ["missense", "nonsense", "readthrough"],
    "snpeff": ["MISSENSE", "NONSENSE"],
    "typed": ["COMPLETE_GENE_DELETION", "PARTIAL_GENE_DELETION", "WITHIN_GENE_DELETION", "MISSENSE_START", "NONSENSE", "FRAMESHIFT", "DONOR_IN2", "ACCEPTOR_IN2", "CREATE_ACCEPTOR_IN15", "READTHROUGH", "MISSENSE"],
}
# The standard genetic code, bases in the order T, C, A, G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, INS, DEL, SV, MIXED, MONO or UNKNOWN."""
    r, a = F.upper(ref), F.upper(alt)
    return (
        F.when(a.isNull() | (a == ".") | (r == a), "MONO").when(F.contains(a, F.lit(",")), "MIXED").when(~a.rlike("^[ACGT]+$") | ~r.rlike("^[ACGT]+$"), "SV")
        .when((F.length(r) == 1) & (F.length(a) == 1), "SNP").when((F.length(r) < F.length(a)) & a.startswith(r), "INS").when((F.length(r) > F.length(a)) & r.startswith(a), "DEL").otherwise("UNKNOWN")
    )


def first_allele(alt: Column) -> Column:
    return F.split(alt, ",")[0]


def codon_table(spark: SparkSession) -> DataFrame:
    """codon, aa: the standard genetic code as a small table."""
    return spark.createDataFrame([(a + b + c, _AMINO[16 * i + 4 * j + k]) for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")], "codon string, aa string")


def translate(codon: Column) -> Column:
    """Amino acid of a codon (null for another text), as a literal map."""
    pairs = [x for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG") for x in (F.lit(a + b + c), F.lit(_AMINO[16 * i + 4 * j + k]))]
    return F.element_at(F.create_map(*pairs), F.upper(codon))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def consequence(before: Column, after: Column, codon_number: Column) -> Column:
    """What a changed codon does to the protein."""
    a, b = translate(before), translate(after)
    return (
        F.when(a.isNull() | b.isNull(), "SNV").when((a != "*") & (b == "*"), "Stop_Gain").when((a == "*") & (b != "*"), "Stop_Loss").when((a != "M") & (b == "M") & (codon_number <= 1), "Start_Gain")
        .when((a == "M") & (b != "M") & (codon_number <= 1), "Start_Loss").when(a == b, "Synonymous").otherwise("Nonsynonymous")
    )


def derive_parts(genes: DataFrame) -> DataFrame:
    """genes (1-based tx_start..tx_end, cds_start..cds_end, exons) with arrays cds, utr5 and utr3; swapped on the minus strand."""
    clip = lambda lo, hi: F.filter(F.transform("exons", lambda e: F.struct(F.greatest(e["beg"], lo).alias("beg"), F.least(e["end"], hi).alias("end"))), lambda e: e["beg"] <= e["end"])
    coding = F.col("cds_start") <= F.col("cds_end")
    none = F.expr("cast(array() as array<struct<beg:bigint,end:bigint>>)")
    low, high = F.when(coding, clip(F.col("tx_start"), F.col("cds_start") - 1)).otherwise(none), F.when(coding, clip(F.col("cds_end") + 1, F.col("tx_end"))).otherwise(none)
    minus = F.col("strand") == "-"
    return genes.withColumns({"cds": F.when(coding, clip(F.col("cds_start"), F.col("cds_end"))).otherwise(none), "utr5": F.when(minus, high).otherwise(low), "utr3": F.when(minus, low).otherwise(high)})


def coding_offset(pos: Column) -> Column:
    """0-based place of pos within the coding sequence, along the strand; null outside."""
    inside = F.exists("cds", lambda e: (e["beg"] <= pos) & (pos <= e["end"]))
    before = F.aggregate("cds", F.lit(0).cast("long"), lambda s, e: s + F.when(e["end"] < pos, e["end"] - e["beg"] + 1).when(e["beg"] <= pos, pos - e["beg"]).otherwise(0))
    total = F.aggregate("cds", F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["beg"] + 1)
    return F.when(inside, F.when(F.col("strand") == "-", total - 1 - before).otherwise(before))


def region_class(pos: Column, up: int = 50, down: int = 50, exon_splice: int = 3, intron_splice: int = 8) -> Column:
    """Where a base lies in a gene model with parts: a list of types for one position."""
    within = lambda parts: F.exists(parts, lambda e: (e["beg"] <= pos) & (pos <= e["end"]))
    minus, n = F.col("strand") == "-", F.size("exons")
    left, right = (pos < F.col("tx_start")), (pos > F.col("tx_end"))
    upstream = F.when(minus, right & (pos <= F.col("tx_end") + up)).otherwise(left & (pos >= F.col("tx_start") - up))
    downstream = F.when(minus, left & (pos >= F.col("tx_start") - down)).otherwise(right & (pos <= F.col("tx_end") + down))
    inner = lambda lo, hi: F.exists(F.transform("exons", lambda e, i: F.struct(e["beg"].alias("beg"), e["end"].alias("end"), i.alias("i"))), lambda e: ((e["i"] > 0) & (pos >= e["beg"] - hi) & (pos <= e["beg"] - lo)) | ((e["i"] < n - 1) & (pos <= e["end"] + hi) & (pos >= e["end"] + lo)))
    noncoding = F.size("cds") == 0
    body = F.when(within("utr5"), "Utr5").when(within("utr3"), "Utr3").when(within("cds"), "Coding").when(within("exons"), F.when(noncoding, "Noncoding").otherwise("Exon")).when(~left & ~right, "Intron")
    splice = F.when(inner(1, 2), "Essential_Splice_Site").when(inner(-exon_splice + 1, intron_splice), "Normal_Splice_Site")
    flank = F.when(upstream, "Upstream").when(downstream, "Downstream")
    return F.array_compact(F.array(flank, body, splice))


def indel_class(ref: Column, alt: Column, cds_bases: Column) -> Column:
    """Types of an insertion or deletion that touches coding sequence."""
    size = F.abs(F.length(alt) - F.length(ref))
    return F.when(F.length(alt) > F.length(ref), F.when(size % 3 == 0, "CodonGain").otherwise("Frameshift")).otherwise(F.when(cds_bases % 3 == 0, "CodonLoss").otherwise("Frameshift"))


def annotate(variants: DataFrame, genes: DataFrame, flank: int = 50, bin_size: int = 100_000, bases: DataFrame | None = None) -> DataFrame:
    """variants (marker, contig, pos, ref, alt) with one row per transcript and type: vtype, gene, transcript, strand, n_exons, type, detail.

    Candidates by range join of gene spans widened by flank; the classes are expressions over
    the exon arrays. Codons refine coding changes, each for its own gene and strand: they are
    found from bases (contig, pos, base of the reference), or are columns already, of a variant
    (codon, codon_alt) or of a variant and gene (the rows of with_codons()). detail names the
    codons and amino acids. genes may name its transcript. Variants near no gene are
    Intergenic, monomorphic ones Monomorphic.
    """
    named = genes if "transcript" in genes.columns else genes.withColumn("transcript", F.col("gene"))
    if bases is not None:
        variants = with_codons(variants.select("marker", "contig", "pos", "ref", "alt"), named.drop("gene").withColumnRenamed("transcript", "gene"), bases, bin_size)
    of = None  # codons by marker and transcript
    if {"gene", "codon"} <= set(variants.columns):
        key = "transcript" if bases is not None else "gene"
        of = variants.where("gene is not null").select("marker", F.col("gene").alias(key), "codon", "codon_alt").distinct()
        variants = variants.drop("gene", "codon", "codon_alt").distinct()
    g = derive_parts(named).withColumns({"_beg": F.col("tx_start") - flank, "_end": F.col("tx_end") + flank})
    v = variants.withColumn("vtype", variant_type(F.col("ref"), F.col("alt")))
    near = range_join(v, g, "contig", "pos", "_beg", "_end", bin_size)
    if of is not None:
        near = near.join(of, ["marker", key], "left")
    elif "codon" not in near.columns:
        near = near.withColumns({"codon": F.lit(None).cast("string"), "codon_alt": F.lit(None).cast("string")})
    bases = F.size(F.filter(F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1), lambda p: F.exists("cds", lambda e: (e["beg"] <= p) & (p <= e["end"])) & (p > F.col("pos"))))
    coding = F.when(F.col("vtype") == "SNP", consequence(F.col("codon"), F.col("codon_alt"), F.floor(coding_offset(F.col("pos")) / 3) + 1)).when(F.col("vtype").isin("INS", "DEL"), indel_class(F.col("ref"), F.col("alt"), bases)).otherwise("CodonRegion")
    t = F.transform(region_class(F.col("pos"), flank, flank), lambda x: F.when(x == "Coding", coding).otherwise(x))
    place = (F.floor(coding_offset(F.col("pos")) / 3) + 1).cast("string")
    change = F.concat(F.col("codon"), F.lit("->"), F.col("codon_alt"), F.lit(":"), translate(F.col("codon")), place, translate(F.col("codon_alt")))
    found = near.select("marker", "gene", "transcript", "strand", F.size("exons").alias("n_exons"), change.alias("detail"), F.explode(F.when(F.col("vtype") == "SV", F.concat(F.array(F.lit("StructuralVariation")), t)).when(F.col("vtype") == "MONO", F.array(F.lit("Monomorphic"))).otherwise(t)).alias("type"))
    out = v.select("marker", "contig", "pos", "vtype").join(found, "marker", "left")
    out = out.withColumn("type", F.coalesce("type", F.when(F.col("vtype") == "MONO", "Monomorphic").otherwise("Intergenic")))
    protein = F.col("type").isin("Stop_Gain", "Stop_Loss", "Start_Gain", "Start_Loss", "Nonsynonymous", "Synonymous")
    return out.withColumn("detail", F.when(protein, F.col("detail")))


def with_codons(variants: DataFrame, genes: DataFrame, bases: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """variants (marker, contig, pos, ref, alt) with gene, codon and codon_alt, one row per gene whose coding sequence holds the base.

    bases: contig, pos, base of the reference. A codon's three places are found along the exons,
    the bases come by joins on (contig, pos); on the minus strand they are complemented.
    Only single bases have a codon; codons with unknown bases are null.
    """
    g = derive_parts(genes)
    v = variants.where((F.length("ref") == 1) & (F.length("alt") == 1))
    x = range_join(v, g, "contig", "pos", "tx_start", "tx_end", bin_size).withColumn("at", coding_offset(F.col("pos"))).where("at is not null")
    along = F.flatten(F.transform("cds", lambda e: F.sequence(e["beg"], e["end"])))
    x = x.withColumn("sites", F.when(F.col("strand") == "-", F.reverse(along)).otherwise(along))
    x = x.select("marker", "contig", "gene", "strand", "alt", F.pmod("at", F.lit(3)).alias("frame"), F.posexplode(F.slice("sites", (F.col("at") - F.pmod("at", F.lit(3)) + 1).cast("int"), 3)).alias("i", "spot"))
    x = x.join(bases.select("contig", F.col("pos").alias("spot"), F.upper("base").alias("base")), ["contig", "spot"], "left")
    strand = lambda c: F.when(F.col("strand") == "-", F.translate(c, "ACGT", "TGCA")).otherwise(c)
    word = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("b")))), lambda s: s["b"]), "")
    out = x.groupBy("marker", "gene").agg(word(strand(F.col("base"))).alias("codon"), word(strand(F.when(F.col("i") == F.col("frame"), F.upper("alt")).otherwise(F.col("base")))).alias("codon_alt"))
    whole = lambda c: F.when(F.length(c) == 3, F.col(c)).alias(c)
    return variants.join(out.select("marker", "gene", whole("codon"), whole("codon_alt")), "marker", "left")


def change_tables(annotated: DataFrame) -> DataFrame:
    """kind, value, n: how often each base change (of single bases), indel length (deletions below 0) and codon change occurs.

    annotated has ref and alt and, for codon changes, codon and codon_alt.
    """
    size = F.length("alt") - F.length("ref")
    plain = F.col("ref").rlike("^[ACGTacgt]+$") & F.col("alt").rlike("^[ACGTacgt]+$")
    arrow = lambda a, b: F.concat_ws("->", F.upper(a), F.upper(b))
    rows = [F.struct(F.lit("base").alias("kind"), F.when(plain & (F.length("ref") == 1) & (size == 0), arrow("ref", "alt")).alias("value")), F.struct(F.lit("indel").alias("kind"), F.when(plain & (size != 0), size.cast("string")).alias("value"))]
    if "codon" in annotated.columns:
        rows.append(F.struct(F.lit("codon").alias("kind"), F.when(F.col("codon").isNotNull() & F.col("codon_alt").isNotNull(), arrow("codon", "codon_alt")).alias("value")))
    x = annotated.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("value is not null")
    return x.groupBy("kind", "value").agg(F.count("*").alias("n"))


def annotated_lines(rows: DataFrame, form: str, fields: list[str], anno: str = "anno", full: str = "annofull") -> DataFrame:
    """line: a text line of each row with its annotation, in the form of the input it came from.

    vcf: into the eighth field, after what is there; plain and plink: as further fields; results:
    into the marker id (the fourth field), whose text after the last '_' gives way to it.
    """
    f = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    if form == "vcf":
        info = F.concat_ws(";", F.when(f[7] != "", f[7]), F.concat(F.lit("ANNO="), anno), F.concat(F.lit("ANNOFULL="), full))
        f = [*f[:7], info, *f[8:]]
    elif form == "results":
        f = [*f[:3], F.concat(F.regexp_extract(f[3], r"^([^_]*_[^_]*)", 1), F.lit("_"), anno), *f[4:]]
    elif form in ("plain", "plink"):
        f = [*f, F.coalesce(anno, F.lit("")), F.coalesce(full, F.lit(""))]
    else:
        raise ValueError(form)
    return rows.select(F.concat_ws("\t", *f).alias("line"))


def top_annotation(annotated: DataFrame, priority: list[str] | None = None, keys: tuple[str, ...] = ("marker",)) -> DataFrame:
    """Of each variant the most severe type and its genes: anno 'TYPE:G1|G2'; annofull of all types; by_transcript of all transcripts.

    by_transcript is 'GENE/TRANSCRIPT:STRAND:TYPE(detail):TYPE|...': transcripts by their most
    severe type, of equal ones those of more exons first, then by name; as far as annotated has
    transcript, strand, n_exons and detail. It is null where no gene is near.
    """
    order = {t: i for i, t in enumerate(priority or PRIORITY)}
    rank = F.coalesce(F.element_at(F.create_map(*[x for t, i in order.items() for x in (F.lit(t), F.lit(i))]), F.col("type")), F.lit(len(order)))
    has = lambda c, kind: (F.col(c) if c in annotated.columns else F.lit(None)).cast(kind)
    ranked = annotated.withColumn("_r", rank)
    x = ranked.groupBy(*keys, "type").agg(F.first("_r").alias("_r"), F.array_join(F.array_sort(F.collect_set("gene")), "|").alias("genes"))
    item = F.struct("_r", F.when(F.col("genes") == "", F.col("type")).otherwise(F.concat_ws(":", "type", "genes")).alias("t"))
    top = x.groupBy(*keys).agg(F.min(item)["t"].alias("anno"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["t"]), ",").alias("annofull"))
    one = F.struct("_r", F.concat(F.col("type"), F.coalesce(F.concat(F.lit("("), has("detail", "string"), F.lit(")")), F.lit(""))).alias("t"))
    named = ranked.where("gene is not null").select(*keys, "gene", has("transcript", "string").alias("_tr"), has("strand", "string").alias("_st"), has("n_exons", "int").alias("_ex"), one.alias("_one"))
    per = named.groupBy(*keys, "gene", "_tr", "_st", "_ex").agg(F.array_sort(F.collect_set("_one")).alias("types"))
    name = F.concat_ws(":", F.concat_ws("/", "gene", F.when(F.col("_tr") != F.col("gene"), F.col("_tr"))), "_st", F.array_join(F.transform("types", lambda e: e["t"]), ":"))
    line = F.struct(F.col("types")[0]["_r"].alias("r"), (-F.coalesce("_ex", F.lit(0))).alias("less"), F.col("gene").alias("g"), F.col("_tr").alias("tr"), name.alias("s"))
    full = per.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["s"]), "|").alias("by_transcript"))
    return top.join(full, list(keys), "left")


def frequency_table(df: DataFrame, *cols: str) -> DataFrame:
    """Counts of each value, rarest first (by row order columns n and the values)."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy("n", *cols)


def tag_intervals(points: DataFrame, spans: DataFrame, tag: str, label: str = "label", keys: tuple[str, ...] = ("marker",), bin_size: int = 100_000) -> DataFrame:
    """points with a column tag: the distinct labels of spans that hold them, comma-joined (null: none)."""
    hit = range_join(points, spans, "contig", "pos", "beg", "end", bin_size).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias(tag))
    return points.join(hit, list(keys), "left")


def exact_lookup(variants: DataFrame, table: DataFrame, value: str, on: tuple[str, ...] = ("contig", "pos", "ref", "alt"), order: str | tuple[str, ...] = "line", missing: str = "NA") -> DataFrame:
    """variants with value of the first matching row of table, missing where there is none.

    order must tell the matching rows of a key apart: which of equal ones comes first is left to the shuffle otherwise.
    """
    w = Window.partitionBy(*on).orderBy(*([order] if isinstance(order, str) else order))
    one = table.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*on, value)
    return variants.join(one, list(on), "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(missing)))


ANNO_PATTERNS = {
    "plain": (r"ANNO=([^;:]+):([^;]+)", 1, 2), "snpeff": (r"EFF=([A-Z_]+)\((?:[^|]*\|){5}([^|]*)", 1, 2), "gatk": (r"refseq\.functionalClass[^=]*=([^;]+).*refseq\.name2[^=]*=([^;]+)", 1, 2), "info": (r"ANNO=([^;:|]+)[:|]([^;]+)", 1, 2),
    "typed": (r"TYPE=([^;:]+).*GENE=([^;:]+)", 1, 2),
}


def make_groups(sites: DataFrame, types: list[str] | None = None, form: str = "plain") -> DataFrame:
    """group, markers: variants of the wanted types (those of the NONSYN preset without a list) by gene, in order of position, each once, from INFO texts."""
    types = NONSYN[form] if types is None else types
    pattern, t, g = ANNO_PATTERNS[form]
    x = sites.select("marker", "contig", "pos", F.regexp_extract("info", pattern, t).alias("type"), F.explode(F.array_distinct(F.split(F.regexp_extract("info", pattern, g), r"\|"))).alias("grp"))
    x = x.where(F.col("type").isin(*types) & (F.col("grp") != ""))
    order = F.array_sort(F.collect_set(F.struct("contig", "pos", "marker")))
    return x.groupBy("grp").agg(F.size(order).cast("long").alias("n"), F.array_join(F.transform(order, lambda s: s["marker"].cast("string")), " ").alias("markers"))
