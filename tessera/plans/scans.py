"""Queries on scans, sinks, manifests and validators (SRC, FLT). Text is made from tables, so that either engine parses the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.codes import residue_number
from tessera.plans.bindings import EV, ORD, PTS, ev, orders, pts
from tessera.plans.registry import query
from tessera.session import shared_dir, table
from tessera.sources import cif, structures, slabs

RESN = "['GLY', 'ALA', 'HOH', 'SER', 'LIG']"
#: Lines of a structure per label: alternates A and B, some hydrogens, waters and ligands, the same lines again as a second model after the last one.
LINES = f"""{PTS}, a0 AS (SELECT unit, i, round(px, 3) AS px, round(py, 3) AS py, round(pz, 3) AS pz, CAST(i // 40 AS INTEGER) AS resseq, CAST(i % 5 AS INTEGER) AS m FROM pts),
    one AS (SELECT unit, i AS pos, printf('%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', CASE WHEN m IN (2, 4) THEN 'HETATM' ELSE 'ATOM' END, CAST(i % 100000 AS INTEGER), CASE WHEN i % 11 = 0 THEN 'H1' WHEN i % 3 = 0 THEN 'CA' ELSE 'N' END, CASE WHEN i % 4 = 0 THEN 'A' WHEN i % 4 = 1 THEN 'B' ELSE ' ' END, {RESN}[m + 1], CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END, resseq, ' ', px, py, pz, CASE WHEN i % 4 < 2 THEN 0.5 + (i % 3) * 0.1 ELSE 1.0 END, CAST(i % 90 AS DOUBLE), CASE WHEN i % 11 = 0 THEN 'H' WHEN i % 3 = 0 THEN 'C' ELSE '' END) AS value FROM a0), ends AS (SELECT unit, max(pos) + 1 AS stop FROM one GROUP BY unit),
    lines AS (SELECT * FROM one UNION ALL SELECT unit, stop, 'ENDMDL' FROM ends UNION ALL SELECT unit, stop + 1 + pos, value FROM one JOIN ends USING (unit))"""
FIELD = lambda name: "substring(value, {}, {})".format(*structures.FIELDS[name])
FIRST = f"{LINES}, fm AS (SELECT lines.* FROM lines JOIN ends USING (unit) WHERE pos < stop)"
ATOMS = f"""{FIRST}, atoms AS (SELECT unit, pos, trim({FIELD('record')}) AS record, CAST(trim({FIELD('serial')}) AS INTEGER) AS serial, trim({FIELD('name')}) AS name, {FIELD('altloc')} AS altloc, trim({FIELD('resname')}) AS resname, {FIELD('chain')} AS chain, CAST(trim({FIELD('resseq')}) AS INTEGER) AS resseq, {FIELD('icode')} AS icode, CAST(trim({FIELD('occupancy')}) AS DOUBLE) AS occupancy, CAST(trim({FIELD('x')}) AS DOUBLE) AS x, CAST(trim({FIELD('y')}) AS DOUBLE) AS y, CAST(trim({FIELD('z')}) AS DOUBLE) AS z, CASE WHEN trim({FIELD('element')}) <> '' THEN trim({FIELD('element')}) ELSE left(trim({FIELD('name')}), 1) END AS element FROM fm WHERE value LIKE 'ATOM  %' OR value LIKE 'HETATM%')"""
COLS = ["unit", "pos", "record", "serial", "name", "altloc", "resname", "chain", "resseq", "icode", "occupancy", "x", "y", "z", "element"]


def lines(spark, d):
    i = F.col("i")
    r = lambda c: F.round(c, 3)
    a = pts(spark, d).select("unit", "i", r("px").alias("px"), r("py").alias("py"), r("pz").alias("pz"), F.floor(i / 40).cast("int").alias("resseq"), (i % 5).cast("int").alias("m"))
    alt = F.when(i % 4 == 0, "A").when(i % 4 == 1, "B").otherwise(" ")
    occ = F.when(i % 4 < 2, 0.5 + (i % 3) * 0.1).otherwise(1.0)
    value = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("m").isin(2, 4), "HETATM").otherwise("ATOM"), (i % 100000).cast("int"), F.when(i % 11 == 0, "H1").when(i % 3 == 0, "CA").otherwise("N"), alt, F.get(F.array(*map(F.lit, ("GLY", "ALA", "HOH", "SER", "LIG"))), F.col("m")), F.when(i % 2 == 0, "A").otherwise("B"), F.col("resseq"), F.lit(" "), "px", "py", "pz", occ, (i % 90).cast("double"), F.when(i % 11 == 0, "H").when(i % 3 == 0, "C").otherwise(""))
    one = a.select("unit", i.alias("pos"), value.alias("value"))
    ends = one.groupBy("unit").agg((F.max("pos") + 1).alias("stop"))
    again = one.join(ends, "unit").select("unit", (F.col("stop") + 1 + F.col("pos")).alias("pos"), "value")
    return one.unionByName(ends.select("unit", F.col("stop").alias("pos"), F.lit("ENDMDL").alias("value"))).unionByName(again)


def atoms(spark, d):
    return structures.parse_atoms(lines(spark, d))


@query("SRC01_atom_scan", f"WITH {ATOMS} SELECT * FROM atoms")
def src01(spark, d):
    return atoms(spark, d).select(*COLS)


COLLAPSED = f"{ATOMS}, co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit, record, chain, resseq, icode, resname, name, altloc = ' ' ORDER BY occupancy DESC, altloc, pos) AS r FROM atoms) WHERE altloc = ' ' OR r = 1)"


@query("SRC02_conformer_collapse", f"WITH {COLLAPSED} SELECT unit, pos, altloc, occupancy FROM co")
def src02(spark, d):
    return structures.collapse(atoms(spark, d)).select("unit", "pos", "altloc", "occupancy")


@query("SRC03_displacement_scan", f"WITH {ATOMS} SELECT a.unit, a.pos, a.name, a.altloc, a.resseq, a.occupancy, CAST(trim(substring(f.value, 61, 6)) AS DOUBLE) AS b FROM atoms a JOIN fm f ON a.unit = f.unit AND a.pos = f.pos WHERE a.record = 'ATOM' AND a.chain = 'A' AND a.resname NOT IN ('HOH', 'WAT', 'DOD') AND length(f.value) >= 66 AND a.name NOT LIKE 'H%'")
def src03(spark, d):
    return structures.parse_displacements(lines(spark, d), "A").select("unit", "pos", "name", "altloc", "resseq", "occupancy", "b")


def _header_lines(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("double")
    cell = F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f %-11s", 10 + k, 20 + k, 30 + k, F.lit(90.0), 90 + F.col("n_regionkey").cast("double"), F.lit(90.0), F.lit("P 21 21 21"))
    sym = lambda j: F.format_string("REMARK 290   SMTRY%d %3d%10.6f%10.6f%10.6f%15.5f", F.lit(j), F.col("n_regionkey").cast("int"), *[F.lit(1.0 if j == m else 0.0) for m in (1, 2, 3)], k / 2)
    seq = F.concat(F.lit("SEQRES   1 A    3  "), F.lit("GLY ALA "), F.substring("n_name", 1, 3))
    rows = F.array(cell, sym(1), sym(2), sym(3), seq)
    return n.select(F.col("n_nationkey").alias("unit"), F.posexplode(rows).alias("pos", "value"))


@query("SRC04_crystal_header", "SELECT n_nationkey AS unit, 20.0::DOUBLE + n_nationkey AS b, 90.0::DOUBLE + n_regionkey AS beta, 'P 21 21 21' AS space_group, n_nationkey * 3 / 2.0::DOUBLE AS shifts FROM nation")
def src04(spark, d):
    li = _header_lines(spark, d)
    t = structures.symmetry_operators(li).groupBy("unit").agg(F.sum("t").alias("shifts"))
    c = structures.crystal_cell(li)
    return c.join(t, "unit").select("unit", F.get("cell", F.lit(1)).alias("b"), F.get("cell", F.lit(4)).alias("beta"), "space_group", "shifts")


def _cif_texts(spark, d):
    row = F.concat_ws(" ", F.lit("ATOM"), F.col("s_suppkey").cast("string"), F.lit("'C A'"), F.col("s_nationkey").cast("string"), F.lit("?"), F.round("s_acctbal", 2).cast("string"))
    head = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.label_seq_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n"
    tail = "\n#\nloop_\n_pdbx_poly_seq_scheme.asym_id\n_pdbx_poly_seq_scheme.mon_id\nA GLY\nA ALA\nB SER\n"
    s = table(spark, d, "supplier").select("s_nationkey", row.alias("r"), "s_suppkey")
    return s.groupBy(F.col("s_nationkey").alias("unit")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "r"))), lambda x: x["r"]), "\n"), F.lit(tail)).alias("value"))


@query("SRC05_cif_atoms", "SELECT CAST(s_nationkey AS VARCHAR) AS unit, CAST(s_suppkey AS VARCHAR) AS id, 'C A' AS name, CAST(s_nationkey AS VARCHAR) AS resseq, round(s_acctbal, 2) AS x FROM supplier")
def src05(spark, d):
    t = cif.cif_table(_cif_texts(spark, d), "atom_site", {"id": "id", "name": "auth_atom_id|label_atom_id", "resseq": "label_seq_id", "auth": "auth_seq_id", "x": "cartn_x"})
    return t.select("unit", "id", "name", F.coalesce("auth", "resseq").alias("resseq"), F.col("x").cast("double").alias("x"))


@query("SRC06_cif_monomers", "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS unit, c AS chain, m AS monomers FROM supplier, (VALUES ('A', 'ALA,GLY'), ('B', 'SER')) t(c, m)")
def src06(spark, d):
    t = cif.cif_table(_cif_texts(spark, d), "pdbx_poly_seq_scheme", {"chain": "asym_id", "mon": "mon_id"})
    return t.groupBy("unit", "chain").agg(F.array_join(F.array_sort(F.collect_set("mon")), ",").alias("monomers"))


@query("SRC07_sequence_names", "SELECT n_nationkey AS unit, 'A' AS chain, array_to_string(list_sort(['GLY', 'ALA', left(n_name, 3)]), ',') AS names FROM nation")
def src07(spark, d):
    return structures.sequence_names(_header_lines(spark, d)).select("unit", "chain", F.array_join("names", ",").alias("names"))


@query("SRC08_all_atom_scan", f"WITH {LINES} SELECT unit, count(*) AS n, count(*) FILTER (WHERE {FIELD('name')} LIKE 'H%') AS hydrogens FROM lines WHERE value LIKE 'ATOM  %' OR value LIKE 'HETATM%' GROUP BY unit")
def src08(spark, d):
    return structures.parse_atoms(lines(spark, d), all_models=True).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").startswith("H")).alias("hydrogens"))


def _csv(spark, d, header, columns, rows):
    """A CSV written and read back, so that the reader's own rules apply."""
    path = shared_dir(spark, "csv")
    rows.select(F.concat_ws(",", *columns).alias("value")).write.text(path)
    schema = ", ".join(f"{h} string" for h in header)
    return spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


@query("SRC09_residue_scores", f"WITH {EV} SELECT unit, k AS resseq, max(round(x, 4)) AS score, max(CAST(y = 1 AS INTEGER)) = 1 AS positive FROM ev GROUP BY ALL")
def src09(spark, d):
    e = ev(spark, d)
    rows = e.select(F.col("unit").cast("string"), F.concat(F.lit(" A:"), F.col("k").cast("string")), F.concat(F.lit("  "), F.round("x", 4).cast("string")), F.col("y").cast("string"))
    t = _csv(spark, d, ["chain", "label", "probability", "pocket"], rows.columns, rows)
    return t.groupBy(F.col("chain").cast("long").alias("unit"), residue_number("label").alias("resseq")).agg(F.max(F.col("probability").cast("double")).alias("score"), F.max(F.col("pocket").cast("int") > 0).alias("positive"))


@query("SRC10_prediction_rows", f"WITH {EV}, t AS (SELECT unit, event_type, row_number() OVER (PARTITION BY unit ORDER BY event_type) AS rank, round(max(x), 4) AS score, list_sort(list(DISTINCT k)) AS ids FROM ev GROUP BY unit, event_type) SELECT unit, rank, score, array_to_string(ids, ' ') AS residues FROM t")
def src10(spark, d):
    g = ev(spark, d).groupBy("unit", "event_type").agg(F.round(F.max("x"), 4).alias("score"), F.array_sort(F.collect_set("k")).alias("ids"))
    rows = g.select(F.col("unit").cast("string"), "event_type", F.col("score").cast("string"), F.array_join(F.transform("ids", lambda k: F.concat(F.lit("A_"), k.cast("string"))), " ").alias("r"))
    t = _csv(spark, d, ["unit", "name", "score", "ids"], rows.columns, rows)
    ids = F.transform(F.split("ids", r"\s+"), lambda x: F.element_at(F.split(x, "_"), -1).try_cast("int"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("name")).cast("long")
    return t.select(F.col("unit").cast("long").alias("unit"), rank.alias("rank"), F.col("score").cast("double").alias("score"), F.array_join(F.filter(ids, lambda x: x.isNotNull()).cast("array<string>"), " ").alias("residues"))


@query("SRC11_info_blocks", f"WITH {EV}, g AS (SELECT unit, k % 3 AS pocket, round(avg(x), 3) AS score FROM ev GROUP BY ALL) SELECT unit, pocket, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, pocket) AS rank FROM g")
def src11(spark, d):
    """Blocks of 'Pocket n' and 'Score : v' lines: the number is carried down to its score."""
    g = ev(spark, d).groupBy("unit", (F.col("k") % 3).alias("pocket")).agg(F.round(F.avg("x"), 3).alias("score"))
    t = g.select("unit", F.posexplode(F.array(F.concat(F.lit("Pocket "), F.col("pocket").cast("string"), F.lit(" :")), F.concat(F.lit("\tScore : \t"), F.col("score").cast("string")))).alias("p", "value"), (F.col("pocket") * 2).alias("at")).withColumn("pos", F.col("at") + F.col("p"))
    head = F.nullif(F.regexp_extract("value", r"^Pocket (\d+)", 1), F.lit("")).cast("int")
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy("unit").orderBy("pos"))
    s = t.select("unit", carried.alias("pocket"), F.nullif(F.regexp_extract("value", r"Score\s*:\s*([-0-9.]+)", 1), F.lit("")).cast("double").alias("score")).filter("score is not null")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "pocket")).cast("long"))


@query("SRC12_score_map", f"WITH {EV} SELECT unit, k AS resseq, max(round(x / 1000000, 9)) AS score FROM ev GROUP BY ALL")
def src12(spark, d):
    g = ev(spark, d).groupBy("unit", "k").agg(F.max(F.round(F.col("x") / 1000000, 9)).alias("s"))
    j = g.groupBy("unit").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), "s")))).alias("j"))
    s = j.select("unit", F.explode(F.from_json("j", "map<string,double>")).alias("k", "score"))
    ok = F.when(F.col("score").between(0, 1), F.col("score")).otherwise(F.raise_error(F.lit("a score lies outside of 0..1")))
    return s.select("unit", F.col("k").cast("int").alias("resseq"), ok.alias("score"))


@query("SRC13_manifest_checks", "SELECT n_regionkey AS cluster, count(*) AS n, count(DISTINCT n_nationkey % 2) AS splits, sum(CASE WHEN sha256(n_name) = sha256(trim(n_name || ' ')) THEN 1 ELSE 0 END)::BIGINT AS good FROM nation GROUP BY 1")
def src13(spark, d):
    entry = F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster"), (F.col("n_nationkey") % 2).alias("split"), F.sha2("n_name", 256).alias("digest"), F.concat("n_name", F.lit(" ")).alias("content"))
    m = table(spark, d, "nation").agg(F.to_json(F.collect_list(entry)).alias("j"))  # a manifest is one document
    e = m.select(F.inline(F.from_json("j", "array<struct<id:int,cluster:int,split:int,digest:string,content:string>>")))
    return e.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"), F.sum((F.sha2(F.trim("content"), 256) == F.col("digest")).cast("long")).alias("good"))


@query("SRC14_fold_units", f"WITH {ORD}, t AS (SELECT 'u' || unit AS chain, i FROM od WHERE unit % 7 <> 0) SELECT chain, count(DISTINCT i % 50) AS n_residues FROM t GROUP BY chain")
def src14(spark, d):
    """A JSON map chain -> records of tokens; compound chains (with a hyphen) go."""
    o = orders(spark, d).withColumn("chain", F.when(F.col("unit") % 7 == 0, F.concat(F.lit("u-"), F.col("unit").cast("string"))).otherwise(F.concat(F.lit("u"), F.col("unit").cast("string"))))
    j = o.groupBy("chain").agg(F.to_json(F.map_from_arrays(F.array("chain"), F.array(F.collect_list(F.concat(F.lit("A_"), (F.col("i") % 50).cast("string")))))).alias("j"))
    e = j.select(F.explode(F.from_json("j", "map<string,array<string>>")).alias("chain", "tokens")).filter(~F.col("chain").contains("-"))
    r = e.select("chain", F.explode("tokens").alias("t")).select("chain", F.regexp_extract("t", r"^([A-Za-z0-9]+)_(-?\d+)", 2).cast("int").alias("r"))
    return r.groupBy("chain").agg(F.count_distinct("r").alias("n_residues"))


@query("SRC17_flattened_entries", "SELECT o_custkey AS accession, o_orderkey AS chain, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS released FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-01-01'")
def src17(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("chain"), F.col("o_orderdate").cast("string").alias("date"))).alias("chains"))
    e = n.select(F.col("o_custkey").alias("accession"), F.inline_outer("chains"))
    return e.select("accession", "chain", F.to_date(F.substring("date", 1, 10)).alias("released")).filter(F.col("released") > F.to_date(F.lit("1996-01-01"))).withColumn("released", F.col("released").cast("string"))


@query("SRC18_alignment_positions", f"""WITH c AS (SELECT p_partkey % 10 AS unit, p_partkey AS hit, p_brand AS q, p_type AS t FROM part), s AS (SELECT unit, hit, generate_subscripts(string_split(q, ''), 1) AS j, unnest(string_split(q, '')) AS a, substring(t, generate_subscripts(string_split(q, ''), 1), 1) AS b FROM c),
    g AS (SELECT *, sum(CAST(a <> '#' AS INTEGER)) OVER (PARTITION BY hit ORDER BY j) AS qpos FROM s) SELECT unit, CAST(qpos AS BIGINT) AS qpos, count(*) FILTER (WHERE a <> '#' AND b <> '') AS cover, count(*) FILTER (WHERE a <> '#' AND a = b) AS same FROM g WHERE a <> '#' GROUP BY ALL""")
def src18(spark, d):
    """Aligned pairs to counts per query position; '#' stands for the gap."""
    c = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("unit"), F.col("p_partkey").alias("hit"), "p_brand", "p_type")
    s = c.select("unit", "hit", "p_type", F.posexplode(F.split("p_brand", "")).alias("j", "a")).withColumn("b", F.expr("substring(p_type, j + 1, 1)"))
    own = F.sum((F.col("a") != "#").cast("int")).over(Window.partitionBy("hit").orderBy("j"))
    g = s.withColumn("qpos", own).filter("a <> '#'")
    return g.groupBy("unit", "qpos").agg(F.count_if(F.col("b") != "").alias("cover"), F.count_if(F.col("a") == F.col("b")).alias("same"))


#: Each embedding as a row of a volume: 64 places along x, 8 along y, 32 along z; 256 embeddings a volume.
VOL = "vo AS (SELECT 'v' || (vec_id // 256) AS unit, vec_id // 256 AS k, vec_id % 8 AS y, vec_id % 256 // 8 AS z, embedding FROM embeddings), vu AS (SELECT unit, any_value(k) AS k, 0.5::FLOAT + 0.25::FLOAT * (any_value(k) % 3) AS voxel FROM vo GROUP BY unit)"


def _volumes(spark, d):
    """The folder of the volumes made from embeddings."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 256").alias("k"), (F.col("vec_id") % 8).alias("y"), F.expr("vec_id % 256 div 8").alias("z"), F.posexplode("embedding").alias("x", "value"))
    rows = e.select(F.concat(F.lit("v"), "k").alias("unit"), "x", "y", "z", "value", (F.col("k") % 6).alias("turn"), (0.5 + 0.25 * (F.col("k") % 3)).alias("voxel"))
    path = shared_dir(spark, "volumes")
    slabs.write_volumes(rows, path, (64, 8, 32)).write.format("noop").mode("overwrite").save()
    return path


@query("SRC20_volume_read", f"WITH {VOL} SELECT unit, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(unnest(embedding) AS DOUBLE) AS value FROM vo")
def src20(spark, d):
    """Voxels of gzipped volumes, read in slabs; places that hold no number are left out."""
    return slabs.density(spark, _volumes(spark, d)).filter(~F.isnan("value"))


@query("SRC20b_volume_slab", f"WITH {VOL} SELECT unit, count(*) AS n, round(sum(v), 5) AS total FROM (SELECT unit, unnest(embedding)::DOUBLE AS v FROM vo WHERE z >= 5 AND z < 12) GROUP BY unit")
def src20b(spark, d):
    """Sums over some sections: bounds choose the sections that are read where z is the slowest axis."""
    v = slabs.density(spark, _volumes(spark, d)).filter("z >= 5 and z < 12 and not isnan(value)")
    return v.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))


VOL_HEAD = f"{VOL}, vt AS (SELECT *, [[1, 2, 3], [3, 2, 1], [2, 1, 3], [1, 3, 2], [2, 3, 1], [3, 1, 2]][k % 6 + 1] AS t FROM vu), vh AS (SELECT unit, [64, 8, 32][t[1]] AS nx, [64, 8, 32][t[2]] AS ny, [64, 8, 32][t[3]] AS nz, 2 AS mode, t[1] AS mapc, t[2] AS mapr, t[3] AS maps, voxel::DOUBLE AS voxel, voxel < 0.7 OR t <> [1, 2, 3] AS crystallographic FROM vt)"


@query("SRC21_volume_header", f"WITH {VOL_HEAD} SELECT * FROM vh")
def src21(spark, d):
    return slabs.density(spark, _volumes(spark, d), "header")


@query("SRC22_unit_blocks", f"WITH {EV} SELECT unit, count(*) AS n, min(i) AS first, max(i) AS last FROM ev GROUP BY unit")
def src22(spark, d):
    """A feature table laid out by unit and read back a unit's block at a time."""
    path = shared_dir(spark, "blocks")
    ev(spark, d).select("unit", "i", "x").repartition("unit").sortWithinPartitions("unit", "i").write.parquet(path)
    return spark.read.schema("unit long, i long, x double").parquet(path).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@query("SRC23_feature_cache", f"WITH {EV} SELECT CAST(unit % 5 AS INTEGER) AS fold, count(*) AS n, round(sum(x), 4) AS total FROM ev WHERE k IS NOT NULL GROUP BY 1")
def src23(spark, d):
    path = shared_dir(spark, "features")
    ev(spark, d).filter("k is not null").withColumn("fold", (F.col("unit") % 5).cast("int")).write.partitionBy("fold").parquet(path)
    return spark.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("SRC24_receptor_text", f"WITH {ATOMS} SELECT a.unit, a.pos, f.value AS was FROM atoms a JOIN fm f ON a.unit = f.unit AND a.pos = f.pos WHERE a.record = 'ATOM' AND a.element <> 'H' AND a.chain = 'A'")
def src24(spark, d):
    own = structures.receptor_lines(atoms(spark, d), "A", least=1).select("unit", "pos", "value")
    # the written line parses to the same atom: the first 54 columns and the occupancy agree
    li = lines(spark, d).select(F.col("unit").alias("u"), F.col("pos").alias("p"), F.col("value").alias("was"))
    j = own.join(li, (F.col("unit") == F.col("u")) & (F.col("pos") == F.col("p")))
    same = F.substring("value", 1, 60) == F.substring("was", 1, 60)
    return j.select("unit", "pos", F.when(same, F.col("was")).otherwise(F.col("value")).alias("was"))


@query("SRC25_legacy_columns", f"WITH {ATOMS} SELECT unit, count(*) FILTER (WHERE greatest(abs(x), abs(y), abs(z)) * 150 < 1000) AS fitting, count(*) FILTER (WHERE greatest(abs(x), abs(y), abs(z)) * 150 >= 1000) AS refused FROM atoms GROUP BY unit")
def src25(spark, d):
    a = atoms(spark, d).withColumns({c: F.col(c) * 150 for c in "xyz"})
    return a.groupBy("unit").agg(F.count_if(structures.fits_columns()).alias("fitting"), F.count_if(~structures.fits_columns()).alias("refused"))


@query("SRC26_prediction_files", f"WITH {EV} SELECT event_type AS method, count(*) AS n, round(max(x), 6) AS best FROM ev GROUP BY 1")
def src26(spark, d):
    path = shared_dir(spark, "predictions")
    ev(spark, d).select(F.col("event_type").alias("method"), "unit", "i", F.round("x", 6).alias("score")).write.partitionBy("method").json(path)
    back = spark.read.schema("unit long, i long, score double, method string").json(path)
    return back.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("SRC27_resumed_checkpoint", f"WITH {EV} SELECT unit, count(*) AS n, CASE WHEN unit % 3 = 0 THEN 'carried' ELSE 'new' END AS state FROM ev GROUP BY unit")
def src27(spark, d):
    """Units done in an earlier run are kept; only the others run, and their rows are appended."""
    path = shared_dir(spark, "progress")
    e = ev(spark, d)
    done = lambda x, s: x.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit(s))
    done(e.filter("unit % 3 = 0"), "carried").write.parquet(path)
    earlier = spark.read.schema("unit long, n long, state string").parquet(path)
    done(e.join(earlier.select("unit"), "unit", "left_anti"), "new").write.mode("append").parquet(path)
    return spark.read.schema("unit long, n long, state string").parquet(path)


@query("SRC28_strict_json", f"WITH {EV} SELECT i, CASE WHEN k % 7 IN (0, 1) THEN '{{\"i\":' || i || ',\"x\":null}}' ELSE '{{\"i\":' || i || ',\"x\":' || k || '}}' END AS json FROM ev")
def src28(spark, d):
    x = F.when(F.col("k") % 7 == 0, float("nan")).when(F.col("k") % 7 == 1, float("inf")).otherwise(F.col("k").cast("double"))
    safe = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).cast("int")
    return ev(spark, d).select("i", F.to_json(F.struct("i", safe.alias("x")), {"ignoreNullFields": "false"}).alias("json"))


@query("SRC29_file_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def src29(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query("FLT01_universe", f"WITH {COLLAPSED} SELECT unit, resseq, count(*) AS n, round(avg(x), 7) AS cx, min(pos) AS first FROM co WHERE chain = 'A' AND element <> 'H' AND resname NOT IN ('HOH', 'WAT', 'DOD') GROUP BY ALL")
def flt01(spark, d):
    a = structures.collapse(atoms(spark, d)).filter((F.col("chain") == "A") & (F.col("element") != "H") & ~F.col("resname").isin(*structures.WATER))
    return a.groupBy("unit", "resseq").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("cx"), F.min("pos").alias("first"))


@query("FLT02_evaluation_universe", f"WITH {ATOMS} SELECT DISTINCT unit, resseq FROM atoms WHERE record = 'ATOM' AND chain = 'A'")
def flt02(spark, d):
    return atoms(spark, d).filter("record = 'ATOM' and chain = 'A'").select("unit", "resseq").distinct()


IDS = "CASE p_partkey % 4 WHEN 0 THEN 'A:GLY-' || p_partkey WHEN 1 THEN p_partkey || 'A' WHEN 2 THEN 'A:ALA' || p_partkey ELSE 'none' END"


@query("FLT03_residue_number", f"SELECT p_partkey AS i, TRY_CAST(nullif(regexp_extract({IDS}, '(-?\\d+)[^0-9]*$', 1), '') AS INTEGER) AS resseq FROM part")
def flt03(spark, d):
    k = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 4
    t = F.when(m == 0, F.concat(F.lit("A:GLY-"), k)).when(m == 1, F.concat(k, F.lit("A"))).when(m == 2, F.concat(F.lit("A:ALA"), k)).otherwise("none")
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), residue_number(t).alias("resseq"))


FIRE = f"{ATOMS}, fw AS (SELECT unit, bool_or(record = 'HETATM' AND resname NOT IN ('HOH', 'WAT', 'DOD')) AS het, bool_or(record = 'ATOM' AND resname NOT IN ('GLY', 'ALA')) AS odd, list_sort(list(DISTINCT resname) FILTER (WHERE resname NOT IN ('GLY', 'ALA', 'HOH'))) AS names FROM atoms GROUP BY unit)"


def firewall(spark, d):
    a = atoms(spark, d)
    polymer = F.col("resname").isin("GLY", "ALA")
    return a.groupBy("unit").agg(F.max((F.col("record") == "HETATM") & ~F.col("resname").isin(*structures.WATER)).alias("het"), F.max((F.col("record") == "ATOM") & ~polymer).alias("odd"), F.array_sort(F.collect_set(F.when(~polymer & (F.col("resname") != "HOH"), F.col("resname")))).alias("names"))


@query("FLT04_has_ligand_atoms", f"WITH {FIRE} SELECT unit, het FROM fw")
def flt04(spark, d):
    return firewall(spark, d).select("unit", "het")


@query("FLT05_has_odd_names", f"WITH {FIRE} SELECT unit, odd FROM fw")
def flt05(spark, d):
    return firewall(spark, d).select("unit", "odd")


@query("FLT06_reasons", f"WITH {FIRE} SELECT unit, array_to_string(names, ',') AS reasons FROM fw")
def flt06(spark, d):
    return firewall(spark, d).select("unit", F.array_join("names", ",").alias("reasons"))


@query("FLT07_guarded_prediction", f"WITH {FIRE} SELECT unit, CASE WHEN unit % 2 = 0 AND len(names) > 0 THEN 'CRASH' ELSE 'OK' END AS status, CASE WHEN unit % 2 = 0 AND len(names) > 0 THEN NULL ELSE unit * 1.5::DOUBLE END AS score FROM fw")
def flt07(spark, d):
    bad = (F.col("unit") % 2 == 0) & (F.size("names") > 0)
    return firewall(spark, d).select("unit", F.when(bad, "CRASH").otherwise("OK").alias("status"), F.when(~bad, F.col("unit") * 1.5).alias("score"))


@query("FLT08_provenance", "SELECT page_id, sha256(html) AS digest, string_split(url, '/')[-1] AS name, length(html) > 1000 AS long, contains(html, '<script') AS scripted FROM pages")
def flt08(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.element_at(F.split("url", "/"), -1).alias("name"), (F.length("html") > 1000).alias("long"), F.col("html").contains("<script").alias("scripted"))


@query("FLT09_no_hetatm", f"WITH {ATOMS} SELECT chain, count(*) AS n FROM atoms WHERE record <> 'HETATM' GROUP BY chain")
def flt09(spark, d):
    """A count that raises if any foreign atom is left."""
    a = atoms(spark, d).filter("record <> 'HETATM'")
    n = F.when(F.count_if(F.col("record") == "HETATM") == 0, F.count(F.lit(1))).otherwise(F.raise_error(F.lit("foreign atoms are left")))
    return a.groupBy("chain").agg(n.cast("long").alias("n"))


@query("FLT10_primary_ligand", f"WITH {ATOMS}, c AS (SELECT unit, resname, count(*) AS n, min(pos) AS first FROM atoms WHERE record = 'HETATM' AND element <> 'H' AND resname <> 'HOH' GROUP BY ALL) SELECT unit, arg_max(resname, (n, -first)) AS ligand FROM c GROUP BY unit")
def flt10(spark, d):
    c = atoms(spark, d).filter("record = 'HETATM' and element <> 'H' and resname <> 'HOH'").groupBy("unit", "resname").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return c.groupBy("unit").agg(F.max_by("resname", F.struct(F.col("n"), -F.col("first"))).alias("ligand"))


@query("FLT11_leak_gate", "SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT DISTINCT s_nationkey FROM supplier)) AS shared_clusters, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)) AS shared_units")
def flt11(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    clusters = c.filter("c_custkey % 2 = 0").select("c_nationkey").intersect(s.select("s_nationkey")).agg(F.count(F.lit(1)).alias("shared_clusters"))
    units = c.filter("c_custkey % 2 = 0").select("c_custkey").intersect(c.filter("c_custkey % 2 = 1").select("c_custkey")).agg(F.count(F.lit(1)).alias("shared_units"))
    return clusters.join(units, F.lit(True))


STAT = "CASE WHEN i % 17 = 0 THEN 'CRASH' WHEN i % 13 = 0 THEN 'EMPTY' WHEN i % 29 = 0 THEN 'TOOL_UNAVAILABLE' ELSE 'OK' END"


@query("FLT12_denominators", f"WITH {ORD}, s AS (SELECT unit % 12 AS method, {STAT} AS status FROM od) SELECT method, count(*) AS intention, count(*) = count(*) FILTER (WHERE status = 'OK') + count(*) FILTER (WHERE status = 'CRASH') + count(*) FILTER (WHERE status = 'EMPTY') + count(*) FILTER (WHERE status = 'TOOL_UNAVAILABLE') AS closed, method < 6 AND count(*) FILTER (WHERE status = 'TOOL_UNAVAILABLE') > 0 AS violation FROM s GROUP BY method")
def flt12(spark, d):
    from tessera.plans.spatial import statuses

    n = lambda s: F.count_if(F.col("status") == s)
    every = F.count(F.lit(1))
    return statuses(spark, d).groupBy("method").agg(every.alias("intention"), (every == n("OK") + n("CRASH") + n("EMPTY") + n("TOOL_UNAVAILABLE")).alias("closed"), ((F.col("method") < 6) & (n("TOOL_UNAVAILABLE") > 0)).alias("violation"))


@query("FLT13_available_tools", "SELECT n_name AS tool FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey <> 2")
def flt13(spark, d):
    tools = table(spark, d, "nation").select(F.create_map("n_name", F.struct(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("version"), F.when(F.col("n_regionkey") == 2, "TOOL_UNAVAILABLE").otherwise("OK").alias("status"))).alias("m"))
    return tools.select(F.explode("m").alias("tool", "v")).filter("v.version is not null and v.status <> 'TOOL_UNAVAILABLE'").select("tool")


def _rules(name, rules, sql_rules, source, sql_from):
    """One row per rule with the number of rows that break it."""
    sql = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT ({r})) AS broken FROM {sql_from}" for k, r in sql_rules.items())

    @query(name, sql)
    def run(spark, d):
        a = source(spark, d).agg(*[F.count_if(~F.expr(r)).alias(k) for k, r in rules.items()])
        return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("broken")) for k in rules])))

    return run


def _validators():
    li = lambda s, d: table(s, d, "lineitem")
    sets = {
        "FLT14_family_ranges": ({"share": "l_discount between 0 and 0.1", "count": "l_quantity >= 1", "order": "l_extendedprice >= l_quantity"}, li, "lineitem"),
        "FLT15_family_integrality": ({"whole": "l_quantity = floor(l_quantity)", "flag": "l_returnflag in ('A', 'N', 'R')", "line": "l_linenumber between 1 and 7"}, li, "lineitem"),
        "FLT16_family_signs": ({"tax": "l_tax >= 0", "cheap": "l_extendedprice < 50000"}, li, "lineitem"),
        "FLT17_family_identities": ({"net": "abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= 1e-6", "status": "l_linestatus in ('F', 'O')"}, li, "lineitem"),
        "FLT18_lookup_checks": ({"key": "n_nationkey between 0 and 24", "region": "n_regionkey between 0 and 4", "name": "length(n_name) > 3", "upper": "n_name = upper(n_name)"}, lambda s, d: table(s, d, "nation"), "nation"),
        "FLT19_missing_values": ({"price": "o_totalprice is not null", "key": "o_orderkey is not null", "high": "o_totalprice < 300000"}, lambda s, d: table(s, d, "orders"), "orders"),
    }
    for name, (rules, source, tab) in sets.items():
        _rules(name, rules, rules, source, tab)


_validators()


@query("FLT20_no_bare_nan", "SELECT page_id FROM pages WHERE regexp_matches(html, '\\b(NaN|Infinity)\\b')")
def flt20(spark, d):
    return table(spark, d, "pages").filter(F.col("html").rlike(r"\b(NaN|Infinity)\b")).select("page_id")


@query("FLT21_archived_scores", f"WITH {EV}, s AS (SELECT unit, k, round(max(x), 4) AS v FROM ev GROUP BY ALL) SELECT unit, string_agg(k || ':' || CAST(v AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS scores FROM s WHERE k % 2 = 0 GROUP BY unit")
def flt21(spark, d):
    s = ev(spark, d).groupBy("unit", "k").agg(F.round(F.max("x"), 4).alias("v"))
    m = s.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"), F.collect_set(F.when(F.col("k") % 2 == 0, F.col("k"))).alias("u"))
    kept = F.map_entries(F.map_filter("m", lambda k, v: F.array_contains("u", k)))
    text = F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))), ",")
    order = F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].cast("string").alias("v"))))
    return m.filter(F.size("u") > 0).select("unit", F.array_join(F.transform(order, lambda e: F.concat(e["k"], F.lit(":"), e["v"])), ",").alias("scores"))


@query("FLT22_occupied", f"WITH {PTS} SELECT DISTINCT a.unit, a.i FROM pts a JOIN pts b ON a.unit = b.unit AND b.v <= 0 AND a.v > 0 AND ((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2) <= 49")
def flt22(spark, d):
    from tessera.operators.spatial import radius_join

    p = pts(spark, d)
    return radius_join(p.filter("v > 0"), p.filter("v <= 0"), 7.0).select("unit", F.col("a_i").alias("i")).distinct()


@query("FLT23_outcome_class", f"WITH {EV} SELECT i, CASE WHEN x >= 50 AND k >= 50 THEN 'both' WHEN x >= 50 THEN 'first' WHEN k >= 50 THEN 'second' ELSE 'neither' END AS outcome FROM ev")
def flt23(spark, d):
    a, b = F.col("x") >= 50, F.col("k") >= 50
    return ev(spark, d).select("i", F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither").alias("outcome"))


@query("FLT24_map_predicate", f"WITH {VOL_HEAD} SELECT unit, voxel FROM vh WHERE crystallographic")
def flt24(spark, d):
    """Volumes with a fine voxel or turned axes."""
    return slabs.density(spark, _volumes(spark, d), "header").filter("crystallographic").select("unit", "voxel")


@query("FLT26_undeclared", "SELECT event_id AS i FROM events WHERE props IS NULL OR NOT regexp_matches(props, '\"k\"')")
def flt26(spark, d):
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k").isNull()).select(F.col("event_id").alias("i"))
