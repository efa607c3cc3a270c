"""Text output of calls and reads: folders of part files, whose texts joined in the order of their names are the file.

Lines are sorted over all tasks and written in parallel; the header is a row of its own that sorts
first, so it stands in the first part alone. Spark's commit protocol makes the parts appear at once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import phred
from ..operators.merge import wrapped
from ..operators.snv import mean_posterior

CALLS = ("Fvar", "Rvar", "Ftot", "Rtot", "Pval", "Qval")


def number(value: str, state: str) -> Column:
    """A slot as text: the number, - for an absent variant, * for no window."""
    return F.when(F.col(state) == "called", F.format_string("%.4f", value)).when(F.col(state) == "absent", "-").otherwise("*")


def write_lines(lines: DataFrame, by: list[str], path: str, header: list[str] = (), line_end: str = "\n") -> None:
    """The column ``value`` in the order of ``by``, behind the header's lines."""
    kinds = dict(lines.dtypes)
    head = lines.sparkSession.createDataFrame(list(enumerate(header)), "__nth int, value string").select("__nth", *(F.lit(None).cast(kinds[c]).alias(c) for c in by), "value")
    # the header's rows have a number, the others none
    every = head.unionByName(lines.select(F.lit(None).cast("int").alias("__nth"), *by, "value"))
    every.orderBy(F.col("__nth").asc_nulls_last(), *by).select("value").write.mode("overwrite").option("lineSep", line_end).text(path)


def separated(columns: list[Column | str], sep: str) -> Column:
    return F.concat_ws(sep, *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


#: The order of calls in files.
CALL_ORDER = ["chrom", "key_pos", "key_var"]


def call_columns(calls: DataFrame, single: bool = False) -> tuple[DataFrame, list[str]]:
    """Calls with text columns under the names of the CSV output, and these names."""
    head = [F.col("chrom").alias("Chromosome"), F.col("pos").alias("Pos"), F.col("ref").alias("Ref"), F.col("var").alias("Var")]
    if single:
        slots = [F.format_string("%.4f", "frq3").alias("Freq"), F.format_string("%.4f", "pst3").alias("Post")]
    else:
        slots = [number(f"frq{k}", f"state{k}").alias(f"Frq{k}") for k in (1, 2, 3)] + [number(f"pst{k}", f"state{k}").alias(f"Pst{k}") for k in (1, 2, 3)]
    tests = [F.col(c.lower()).alias(c) for c in CALLS if c.lower() in calls.columns]
    out = calls.select(*(F.col(c).alias(f"__{c}") for c in CALL_ORDER), *head, *slots, *tests)
    return out, out.columns[len(CALL_ORDER) :]


def write_calls(calls: DataFrame, path: str, sep: str, single: bool, header: bool, line_end: str) -> None:
    rows, names = call_columns(calls, single)
    by = [f"__{c}" for c in CALL_ORDER]
    write_lines(rows.select(*by, separated(names, sep).alias("value")), by, path, [sep.join(names)] if header else [], line_end)


def write_csv(calls: DataFrame, path: str, single: bool = False) -> None:
    """Header and CRLF line ends."""
    write_calls(calls, path, ",", single, True, "\r\n")


#: What the fields of a VCF line hold.
FIELDS = {
    "Freq": "Frequency of the variant",
    "Post": "Posterior probability of the variant",
    "Fvar": "Number of forward reads with variant",
    "Rvar": "Number of reverse reads with variant",
    "Ftot": "Total number of forward reads",
    "Rtot": "Total number of reverse reads",
    "Pval": "P-value for strand bias",
    "Qval": "Q-value for strand bias",
}


def vcf_lines(calls: DataFrame, lengths: dict[str, int], source: str = "readloom", day: date | None = None, single: bool = False, reference: str = "") -> tuple[DataFrame, list[str]]:
    """(chrom, key_pos, key_var, value): records of a VCFv4.2 file, and its header's lines."""
    info = ["Freq,Post"] if single else ["Freq1,Freq2,Freq3,Post1,Post2,Post3"]
    names = [*info[0].split(","), *CALLS]
    kinds = {c: "Integer" for c in CALLS[:4]}
    meta = ["##fileformat=VCFv4.2", f"##fileDate={(day or date.today()):%Y%m%d}", f"##source={source}"]
    meta += [f"##reference={reference}"] if reference else []
    meta += [f"##contig=<ID={c},length={n}>" for c, n in lengths.items()]
    meta += [f'##INFO=<ID={n},Number=1,Type={kinds.get(n, "Float")},Description="{FIELDS[n[:4]]}{f" in window {n[4:]}" if n[4:] else ""}">' for n in names]
    meta.append("#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO".split()))
    values = {"Freq": "frq3", "Post": "pst3"} | {f"Freq{k}": f"frq{k}" for k in (1, 2, 3)} | {f"Post{k}": f"pst{k}" for k in (1, 2, 3)}
    # an absent variant counts as 0; a slot without a window is left out
    number = lambda n: F.format_string("%.4f", F.coalesce(values[n], F.lit(0.0)))
    slot = lambda n: number(n) if single else F.when(F.col(f"state{n[-1]}") != "none", number(n))
    text = lambda n: slot(n) if n in values else F.col(n.lower()).cast("string")
    fields = F.concat_ws(";", *(F.concat(F.lit(f"{n}="), text(n)) for n in names))
    qual = F.format_string("%.4f", phred(mean_posterior(calls)))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "var", qual, F.lit("PASS"), fields)
    return calls.select(*CALL_ORDER, line.alias("value")), meta


def write_vcf(calls: DataFrame, lengths: dict[str, int], path: str, **options) -> None:
    lines, header = vcf_lines(calls, lengths, **options)
    write_lines(lines, CALL_ORDER, path, header)


def write_corrected(cleaned: DataFrame, path: str, roi_b: int = 0) -> None:
    """Corrected reads as FASTA, 80 columns (K6); the number in a header is the start in the region."""
    lines = cleaned.orderBy("file_ord").select(F.concat(F.lit(">"), "qname", F.lit(" "), (F.col("pos0") + 1 - roi_b).cast("string"), F.lit("\n"), wrapped(F.col("seq"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def entropy_rows(entropy: DataFrame, moving: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(chrom, pos, entropy, mean_entropy, high_entropy_window), rounded to 4 digits."""
    e = entropy.join(moving.select("chrom", "pos", "mean_entropy"), ["chrom", "pos"], "left").join(chosen.select("chrom", "start"), "chrom", "left")
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + width)
    return e.select("chrom", "pos", F.round("entropy", 4).alias("entropy"), F.round("mean_entropy", 4).alias("mean_entropy"), F.coalesce(inside, F.lit(False)).cast("int").alias("high_entropy_window")).orderBy("chrom", "pos")
