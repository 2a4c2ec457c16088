"""Fixed-column structure text: scans, conformers, validity and writers.

Files are read as whole texts (gzip included) and split within the scan task,
so line numbers are exact and nothing is shuffled before the parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an atom line: name -> (first, length), from 1.
FIELDS = {"record": (1, 6), "serial": (7, 5), "name": (13, 4), "altloc": (17, 1), "resname": (18, 3), "chain": (22, 1), "resseq": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6), "b": (61, 6), "element": (77, 2)}
WATER = ("HOH", "WAT", "DOD")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """unit (file name without its endings), pos, value."""
    text = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.(?:pdb|ent|cif|gz))*$", 1)
    return text.select(name.alias("unit"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))


def field(name: str) -> Column:
    at, n = FIELDS[name]
    return F.substring("value", at, n)


def number(name: str, kind: str) -> Column:
    return F.trim(field(name)).try_cast(kind)


def first_model(lines: DataFrame) -> DataFrame:
    """Lines before the unit's first ENDMDL."""
    end = F.min(F.when(F.col("value").startswith("ENDMDL"), F.col("pos"))).over(Window.partitionBy("unit"))
    return lines.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")


def parse_atoms(lines: DataFrame, all_models: bool = False) -> DataFrame:
    """Atoms in file order. A bad occupancy is 1, a missing element the first letter of the name."""
    atoms = (lines if all_models else first_model(lines)).filter(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM"))
    name = F.trim(field("name"))
    element = F.upper(F.coalesce(F.nullif(F.trim(field("element")), F.lit("")), F.nullif(F.regexp_extract(name, "([A-Za-z])", 1), F.lit(""))))
    out = atoms.select("unit", "pos", F.trim(field("record")).alias("record"), number("serial", "int").alias("serial"), name.alias("name"), field("altloc").alias("altloc"), F.trim(field("resname")).alias("resname"), field("chain").alias("chain"), number("resseq", "int").alias("resseq"), field("icode").alias("icode"), F.coalesce(number("occupancy", "double"), F.lit(1.0)).alias("occupancy"), number("x", "double").alias("x"), number("y", "double").alias("y"), number("z", "double").alias("z"), element.alias("element"))
    return out.filter("x is not null and y is not null and z is not null")


def collapse(atoms: DataFrame) -> DataFrame:
    """One conformer: rows without a letter stay; of the others the highest occupancy, then the lowest letter, then the first."""
    key = ["unit", "record", "chain", "resseq", "icode", "resname", "name", F.col("altloc") == " "]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("occupancy"), "altloc", "pos"))
    return atoms.withColumn("_r", rank).filter((F.col("altloc") == " ") | (F.col("_r") == 1)).drop("_r")


def parse_displacements(lines: DataFrame, chain: str) -> DataFrame:
    """All alternates of a chain with B values; hydrogens, waters and short or broken lines are left out."""
    a = first_model(lines).filter(F.col("value").startswith("ATOM  ") & (F.length("value") >= 66) & (field("chain") == chain) & ~F.trim(field("resname")).isin(*WATER))
    out = a.select("unit", "pos", F.trim(field("name")).alias("name"), field("altloc").alias("altloc"), number("resseq", "int").alias("resseq"), field("icode").alias("icode"), number("occupancy", "double").alias("occupancy"), number("b", "double").alias("b"), number("x", "double").alias("x"))
    return out.filter("b is not null and occupancy is not null and x is not null").filter(~F.col("name").startswith("H"))


def crystal_cell(lines: DataFrame) -> DataFrame:
    """unit, cell (six numbers), space group; units without a CRYST1 line give no row."""
    c = lines.filter(F.col("value").startswith("CRYST1"))
    cut = [(7, 9), (16, 9), (25, 9), (34, 7), (41, 7), (48, 7)]
    return c.select("unit", F.array(*[F.trim(F.substring("value", a, n)).try_cast("double") for a, n in cut]).alias("cell"), F.trim(F.substring("value", 56, 11)).alias("space_group"))


def symmetry_operators(lines: DataFrame) -> DataFrame:
    """unit, op, row, r1, r2, r3, t from the symmetry remarks."""
    s = lines.filter(F.col("value").rlike(r"^REMARK 290\s+SMTRY[123]"))
    p = F.split(F.trim(F.substring("value", 14, 60)), r"\s+")
    at = lambda k: F.get(p, F.lit(k))
    return s.select("unit", at(1).try_cast("int").alias("op"), F.substring(at(0), 6, 1).try_cast("int").alias("row"), *[at(k + 1).try_cast("double").alias(f"r{k}") for k in (1, 2, 3)], at(5).try_cast("double").alias("t"))


def sequence_names(lines: DataFrame) -> DataFrame:
    """unit, chain, names: the residue names of SEQRES lines."""
    s = lines.filter(F.col("value").startswith("SEQRES"))
    words = F.filter(F.split(F.trim(F.substring("value", 20, 60)), " +"), lambda w: w != "")
    return s.select("unit", F.substring("value", 12, 1).alias("chain"), F.explode(words).alias("w")).groupBy("unit", "chain").agg(F.array_sort(F.collect_set("w")).alias("names"))


def atom_line() -> Column:
    """Text of an atom row; the serial wraps at 100000."""
    return F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "record", (F.col("serial") % 100000).cast("int"), "name", "altloc", "resname", "chain", "resseq", "icode", "x", "y", "z", "occupancy", F.lit(0.0), "element")


def receptor_lines(atoms: DataFrame, chain: str, least: int = 50) -> DataFrame:
    """unit, pos, value of a chain's heavy polymer atoms; a unit with fewer than `least` is an error."""
    own = atoms.filter((F.col("record") == "ATOM") & (F.col("element") != "H") & (F.col("chain") == chain))
    n = F.count(F.lit(1)).over(Window.partitionBy("unit"))
    checked = own.withColumn("_n", n).withColumn("value", F.when(F.col("_n") >= least, atom_line()).otherwise(F.raise_error(F.concat(F.lit("too few atoms in "), F.col("unit").cast("string")))))
    return checked.select("unit", "pos", "value")


def fits_columns() -> Column:
    """Whether an atom row can be told in fixed columns at all."""
    wide = F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))
    return (wide < 1000) & F.col("resseq").between(-999, 9999) & (F.length("chain") == 1) & (F.length("resname") <= 3) & (F.length("name") <= 4)
