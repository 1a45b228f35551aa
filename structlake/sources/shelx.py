r"""Packed record texts: headers, full structures, selection and writing.

A record runs from ``TITL`` to ``END``. Files are read with the record end as the
line separator, so large packed files are split between tasks. Files with carriage
returns or blanks after END are read whole instead (``whole=True``); a row that holds
more than one record, as such files give otherwise, raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem

HEADER = ("label", "pressure", "volume", "enthalpy", "spin", "abs_spin", "natoms", "symm", "flag1", "flag2", "flag3")
_NUMERIC = {"pressure": "double", "volume": "double", "enthalpy": "double", "spin": "double", "abs_spin": "double", "natoms": "int"}


def read_record_texts(spark: SparkSession, paths: list[str] | str, whole: bool = False) -> DataFrame:
    """fname, text: one row per record."""
    reader = spark.read
    if whole:
        rows = reader.text(paths, wholetext=True)
        texts = rows.select(F.col("_metadata.file_path").alias("fname"), F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"(?m)^END[^\n]*$")).alias("text"))
    else:
        rows = reader.option("lineSep", "\nEND\n").text(paths)
        # a second title in a row: its records don't end by a bare END
        several = F.regexp_like("value", F.lit(r"(?m)^[ \t]*TITL\s[\s\S]*^[ \t]*TITL\s"))
        value = F.when(several, F.raise_error(F.concat(F.lit("read this file with whole=True: "), F.col("_metadata.file_path")))).otherwise(F.col("value"))
        texts = rows.select(F.col("_metadata.file_path").alias("fname"), F.regexp_replace(value, r"\nEND\s*$", "").alias("text"))
    return texts.filter(F.col("text").rlike(r"(?m)^\s*TITL\s"))


def parse_headers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds the eleven header fields, gen, composition and formula."""
    fields = F.split(F.trim(F.regexp_extract(text, r"(?m)^\s*TITL\s+(.*)$", 1)), r"\s+")
    out = texts.withColumn("_f", fields)
    for k, name in enumerate(HEADER):
        value = F.get("_f", F.lit(k))
        out = out.withColumn(name, value.try_cast(_NUMERIC[name]) if name in _NUMERIC else value)
    atoms = atom_lines(F.col(text))
    species = F.transform(atoms, lambda x: F.element_at(F.split(F.trim(x), r"\s+"), 1))
    out = out.withColumn("composition", chem.composition_of(species)).withColumn("formula", chem.formula_string(F.col("composition")))
    if "fname" in texts.columns:
        out = out.withColumn("gen", F.regexp_extract("fname", r"gen(\d+)", 1).try_cast("int"))
    return out.drop("_f")


def atom_lines(text: Column) -> Column:
    """Lines after SFAC that aren't blank."""
    block = F.regexp_extract(F.concat(text, F.lit("\n")), r"(?ms)^\s*SFAC[^\n]*\n(.*)", 1)
    return F.filter(F.split(block, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("END"))


def scan_shelx_headers(spark: SparkSession, paths: list[str] | str, whole: bool = False) -> DataFrame:
    return parse_headers(read_record_texts(spark, paths, whole))


def parse_structures(records: DataFrame, label: str = "label", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(structures, atoms): cell parameters with lattice, and a row per atom."""
    cell = F.split(F.trim(F.regexp_extract(text, r"(?m)^\s*CELL\s+(.*)$", 1)), r"\s+")
    names = ("a", "b", "c", "alpha", "beta", "gamma")
    cells = records.select(label, *(F.get(cell, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(names)))
    structures = cells.withColumns({"lattice": chem.cell_to_lattice(*map(F.col, names)), "cell_volume": chem.cell_volume(*map(F.col, names))})
    rows = records.select(label, F.posexplode(atom_lines(F.col(text))).alias("_k", "_line")).withColumn("_t", F.split(F.trim("_line"), r"\s+"))
    atoms = rows.select(label, (F.col("_k") + 1).alias("atom"), F.get("_t", F.lit(0)).alias("species"), *(F.get("_t", F.lit(k + 2)).try_cast("double").alias(n) for k, n in enumerate(("fx", "fy", "fz"))))
    return structures, atoms


def load_structures(spark: SparkSession, paths: list[str] | str, threshold: float | None = 10.0, pressure_gpa: float = 0.0, select=F.min, gens: list[int] | None = None, root: str | None = None, whole: bool = False) -> DataFrame:
    """Records of globs (``*``, ``?``) or of generations, corrected and below a threshold.

    With ``gens`` the files are ``root/gen{N}-dft/*.res`` and ``paths`` is ignored.
    Adds ``corrected``, (H + V P) / n per atom, and keeps the records of each formula
    below ``select`` of it plus ``threshold`` (all where that is None).
    """
    from ..operators.records import filter_group_threshold, pressure_corrected_enthalpy

    if gens is not None:
        paths = [f"{root}/gen{n}-dft/*.res" for n in gens]
    rows = pressure_corrected_enthalpy(scan_shelx_headers(spark, paths, whole), "enthalpy", "volume", "natoms", pressure_gpa)
    rows = rows.withColumn("reduced_formula", chem.formula_string(chem.reduce_composition(F.col("composition"))))
    return rows if threshold is None else filter_group_threshold(rows, "reduced_formula", "corrected", threshold, select)


def extract_records(records: DataFrame, needle: str, regex: bool = False, label: str = "label") -> DataFrame:
    """Records whose label contains (or matches) ``needle``."""
    return records.filter(F.col(label).rlike(needle) if regex else F.contains(label, F.lit(needle)))


def save_extracted(records: DataFrame, needle: str, path: str, regex: bool = False, per_label: bool = False, label: str = "label", text: str = "text") -> None:
    """Writes the texts that ``extract_records`` finds.

    Packed, a part file per task; or a folder per label, where labels that are there
    already are skipped.
    """
    found = extract_records(records, needle, regex, label).select(label, F.concat(F.rtrim(F.col(text)), F.lit("\nEND")).alias("text"))
    if per_label:
        spark = records.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            old = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract("_metadata.file_path", f"/{label}=([^/]*)/", 1).alias("_old")).distinct()
            found = found.join(old, F.col(label) == F.url_decode("_old"), "left_anti")
        found.select(label, F.col("text").alias("value")).write.mode("append").partitionBy(label).text(path)
    else:
        write_records(found, path)


def render_records(structures: DataFrame, atoms: DataFrame, header: list[str], label: str = "label") -> DataFrame:
    """label, text: records written back, atoms in order."""
    line = F.format_string("%-7s 1 %.13f %.13f %.13f 1.0", "species", "fx", "fy", "fz")
    body = atoms.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("l")))).alias("_a"), F.array_sort(F.collect_set("species")).alias("_s"))
    title = F.concat_ws(" ", F.lit("TITL"), *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in header))
    cell = F.format_string("CELL 1.54180 %.6f %.6f %.6f %.6f %.6f %.6f", "a", "b", "c", "alpha", "beta", "gamma")
    text = F.concat_ws("\n", title, cell, F.lit("LATT -1"), F.concat(F.lit("SFAC "), F.array_join("_s", " ")), F.array_join(F.transform("_a", lambda x: x["l"]), "\n"), F.lit("END"))
    return structures.join(body, label).select(label, text.alias("text"))


def write_records(texts: DataFrame, path: str, per_label: bool = False, label: str = "label") -> None:
    """One folder per label, or packed files, a part per task."""
    if per_label:
        texts.select(label, F.col("text").alias("value")).write.partitionBy(label).text(path)
    else:
        texts.select(F.col("text").alias("value")).write.text(path)
