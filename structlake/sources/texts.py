"""Other record texts: extended XYZ, calculation logs, job summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..operators.datasets import running
from .paths import kept


#: A frame: the number of its atoms, a line of metadata, lines that begin with a species.
_FRAME = r"(?m)^[ \t]*(\d+)[ \t]*\n([^\n]*)\n((?:[ \t]*[A-Z][a-z]?[ \t][^\n]*(?:\n|\z))+)"
_COUNT_LINE, _ATOM_LINE = r"^[ \t]*\d+[ \t]*$", r"^[ \t]*[A-Z][a-z]?[ \t]"
_LEAD, _WHOLE, _TAIL, _COUNTED = range(4)


def _lines(spark: SparkSession, paths: list[str] | str, limits: dict | None = None) -> DataFrame:
    """fname, block (where the read of the line's byte range began), value."""
    return spark.read.options(**(limits or {})).text(paths).select(F.col("_metadata.file_path").alias("fname"), F.col("_metadata.file_block_start").alias("block"), "value")


def _cut(lines: DataFrame) -> DataFrame:
    """fname, block, kind, n, text: the frames of each byte range, and the pieces at its edges.

    A line that is only a number begins a frame unless the line before is one too (then
    it can be a line of metadata). At a range's first line that can't be told, so all
    before the first sure frame is a lead, which belongs to what the range before has
    left over (a tail). A row of kind _COUNTED gives the number of whole frames.
    """

    def run(batches):
        import re

        import pyarrow as pa
        import pyarrow.compute as pc

        number, atom = re.compile(_COUNT_LINE), re.compile(_ATOM_LINE)
        names = ["fname", "block", "kind", "n", "text"]
        now, rows, pending, found, whole, after = None, [], [], False, 0, False

        def is_frame(x):
            # of several numbers the last, or the one before it, tells the atoms
            r = next((k for k, line in enumerate(x) if not number.match(line)), len(x))
            return any(len(x) > k and bool(atom.match(x[k])) for k in ((r, r + 1) if r > 1 else (r + 1,)))

        def closed(kind):
            if pending:
                rows.append((*now, kind, whole, "\n".join(pending)))

        for batch in batches:
            heads = pc.match_substring_regex(batch.column(2), _COUNT_LINE).to_pylist()
            for fname, block, line, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), heads, strict=True):
                if (fname, block) != now:
                    if now is not None:
                        closed(_TAIL if found else _LEAD)
                        rows.append((*now, _COUNTED, whole, ""))
                    now, pending, found, whole = (fname, block), [], False, 0
                    # the line before a file's first one is none
                    after = block > 0
                if head and not after:
                    if not found:
                        closed(_LEAD)
                    elif is_frame(pending):
                        closed(_WHOLE)
                        whole += 1
                    pending, found = [], True
                pending.append(line)
                after = head
            if len(rows) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                rows = []
        if now is not None:
            closed(_TAIL if found else _LEAD)
            rows.append((*now, _COUNTED, whole, ""))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    import pyarrow as pa

    schema = pa.schema([("fname", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("text", pa.string())])
    return lines.mapInArrow(run, "fname string, block long, kind int, n long, text string")


def _frames_of(text: Column) -> Column:
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(_FRAME), k).alias(n) for k, n in ((1, "n"), (2, "info"), (3, "body"))))


def scan_extxyz(spark: SparkSession, paths: list[str] | str, limits: dict | None = None) -> DataFrame:
    """fname, frame, natoms, metadata (map), atoms (array of species, x, y, z).

    Large files are read in byte ranges by several tasks (``limits`` are options of the
    text reader). Frames within a range stay in its task; the pieces at the ranges' edges
    are put together by file. The files are read twice: once for those pieces and the
    numbers of frames, of which a few rows for each range are kept.
    """
    cut = _cut(_lines(spark, paths, limits))
    edges = kept(cut.filter(F.col("kind") != _WHOLE), "frame-edges")
    # a few rows for each byte range of a file
    along = Window.partitionBy("fname").orderBy("block", "kind")
    pieces = edges.filter(F.col("kind") != _COUNTED).withColumn("_at", F.sum((F.col("kind") == _TAIL).cast("int")).over(along))
    joined = pieces.groupBy("fname", "_at").agg(F.min("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))), lambda x: x["text"]), "\n").alias("text"))
    split = kept(joined.select("fname", "block", (F.col("_at") > 0).alias("_after"), _frames_of(F.col("text")).alias("_all")), "split-frames")
    # what stands before a file's first sure frame comes before the whole ones of its range, a tail after them
    counted = edges.filter(F.col("kind") == _COUNTED).select("fname", "block", F.col("n").alias("_whole"))
    extra = split.groupBy("fname", "block").agg(F.sum(F.when(~F.col("_after"), F.size("_all")).otherwise(0)).alias("_lead"), F.sum(F.size("_all")).alias("_extra"))
    whole = counted.join(extra, ["fname", "block"], "left").select("fname", "block", "_whole", F.coalesce("_lead", F.lit(0)).alias("_lead"), (F.col("_whole") + F.coalesce("_extra", F.lit(0))).alias("_n"))
    starts = kept(whole.withColumn("_base", F.sum("_n").over(Window.partitionBy("fname").orderBy("block")) - F.col("_n")), "frame-starts")
    inner = cut.filter(F.col("kind") == _WHOLE).select("fname", "block", "n", _frames_of(F.col("text"))[0].alias("_p")).join(starts, ["fname", "block"])
    outer = split.select("fname", "block", "_after", F.posexplode("_all").alias("_j", "_p")).join(starts, ["fname", "block"])
    rows = inner.select("fname", (F.col("_base") + F.col("_lead") + F.col("n")).alias("frame"), "_p").unionByName(
        outer.select("fname", (F.col("_base") + F.col("_j") + F.when(F.col("_after"), F.col("_lead") + F.col("_whole")).otherwise(0)).alias("frame"), "_p")
    )
    return rows.select("fname", F.col("frame").cast("int").alias("frame"), F.col("_p.n").cast("int").alias("natoms"), _info(F.col("_p.info")).alias("metadata"), _atoms(F.col("_p.body")).alias("atoms"))


def _info(line: Column) -> Column:
    pattern = F.lit(r"""([A-Za-z_][\w-]*)=("[^"]*"|'[^']*'|\S+)""")
    keys = F.regexp_extract_all(line, pattern, 1)
    values = F.transform(F.regexp_extract_all(line, pattern, 2), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(first)


def _atoms(body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    split = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    return F.transform(split, lambda t: F.struct(t[0].alias("species"), *(F.get(t, F.lit(k)).try_cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z")))))


def extxyz_to_records(frames: DataFrame) -> DataFrame:
    """Header columns from metadata: energy, name, spacegroup, times_found."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    group = F.coalesce(meta("spacegroup"), F.lit("(P1)"))
    symm = F.when(group.startswith("("), group).otherwise(F.concat(F.lit("("), group, F.lit(")")))
    composition = chem.composition_of(F.transform("atoms", lambda a: a["species"]))
    return frames.select(meta("name").alias("label"), meta("energy").try_cast("double").alias("enthalpy"), "natoms", symm.alias("symm"), meta("times_found").alias("flag3"), composition.alias("composition"), chem.formula_string(composition).alias("formula"))


_NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
_ENERGY = r"Final free energy[^=\n]*=\s*" + _NUMBER
_FORCE = r"(?m)^\s*\*\s+([A-Z][a-z]?)\s+\d+\s+" + r"\s+".join([_NUMBER] * 3) + r"\s+\*\s*$"
_STRESS = r"(?m)^\s*\*\s+[xyz]\s+" + r"\s+".join([_NUMBER] * 3) + r"\s+\*\s*$"


def scan_castep(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """fname, energies, forces and stresses (arrays of 3), species, per file.

    A file is a row; ``scan_castep_frames`` reads long logs by several tasks.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("fname"), "value")
    energy = F.transform(F.regexp_extract_all("value", F.lit(_ENERGY), 1), lambda x: x.cast("double"))
    force, stress = F.lit(_FORCE), F.lit(_STRESS)
    rows = lambda pattern, first: F.zip_with(F.arrays_zip(*(F.regexp_extract_all("value", pattern, first + k).alias(f"c{k}") for k in range(3))), F.regexp_extract_all("value", pattern, first), lambda z, _: F.array(*(z[f"c{k}"].cast("double") for k in range(3))))
    return whole.select("fname", energy.alias("energies"), rows(force, 2).alias("forces"), F.regexp_extract_all("value", force, 1).alias("species"), rows(stress, 1).alias("stress"))


def scan_castep_frames(spark: SparkSession, paths: list[str] | str, limits: dict | None = None) -> DataFrame:
    """fname, frame (from 1), energy, species, forces and stress (arrays of 3), per frame.

    A frame goes from one energy line to the next. Lines are read in byte ranges by
    several tasks, and only those that tell something are shuffled. What stands before a
    file's first energy is no frame.
    """
    triple = lambda pattern, first: F.array(*(F.regexp_extract("value", pattern, first + k).cast("double") for k in range(3)))
    force, stress = F.col("value").rlike(_FORCE), F.col("value").rlike(_STRESS)
    told = _lines(spark, paths, limits).select(
        "fname",
        "block",
        # grows along the lines of a byte range
        F.monotonically_increasing_id().alias("line"),
        F.when(F.contains("value", F.lit("Final free energy")), F.nullif(F.regexp_extract("value", _ENERGY, 1), F.lit("")).cast("double")).alias("energy"),
        F.when(force, F.regexp_extract("value", _FORCE, 1)).alias("species"),
        F.when(force, triple(_FORCE, 2)).alias("force"),
        F.when(stress, triple(_STRESS, 1)).alias("stress"),
    )
    rows = told.filter("energy is not null or species is not null or stress is not null")
    framed = running(rows, [F.col("block"), F.col("line")], "frame", F.when(F.col("energy").isNotNull(), 1).otherwise(0), by="fname")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("block", "line", c)))), lambda x: x[c])
    got = framed.groupBy("fname", "frame").agg(F.max("energy").alias("energy"), listed("species").alias("species"), listed("force").alias("forces"), listed("stress").alias("stress"))
    return got.filter("frame > 0").select("fname", F.col("frame").cast("int").alias("frame"), "energy", "species", "forces", "stress")


def parse_job_summary(rows: DataFrame, column: str) -> DataFrame:
    """Adds res, all, completed: first nested counts of keys that hold these words."""
    parsed = F.from_json(column, "map<string,map<string,int>>")
    out = rows.withColumn("_j", parsed)
    for word in ("RES", "ALL", "COMPLETED"):
        hit = F.map_values(F.map_filter("_j", _holds(word)))
        out = out.withColumn(word.lower(), F.get(F.map_values(F.get(hit, F.lit(0))), F.lit(0)))
    return out.drop("_j")


def _holds(word: str):
    return lambda k, v: F.contains(k, F.lit(word))


def parse_energy_log(lines: DataFrame, file: str, line_no: str, text: str) -> DataFrame:
    """file, enthalpy, pressure: last token of the last line with each word, else 0."""
    token = F.regexp_extract(F.rtrim(text), r"(\S+)$", 1).try_cast("double")
    last = lambda word: F.coalesce(F.max_by(token, F.when(F.contains(text, F.lit(word)), F.col(line_no))), F.lit(0.0))
    return lines.groupBy(file).agg(last("Enthalpy").alias("enthalpy"), last("Pressure").alias("pressure"))
