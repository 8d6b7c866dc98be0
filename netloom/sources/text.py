"""Readers of hypergraph, placement, parasitics and waveform text formats.

Line formats are read by Spark's splits, so that a file of any size is read by many tasks: lines are numbered inside each
split and the splits' counts, one row a split, are summed up. What holds for the lines after a heading (a time of a
waveform, a net or a section) is carried forward in the same two steps. Statements that run over lines (DEF, SDF, BLIF)
get numbers from running counts of their ends or beginnings, so they are put together also across the border of two
splits. gzip files are one split each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.hypergraph import Hypergraph


#: parts that Spark wrote into a folder
_PARTS = r"^(.*)/part-(\d+)-[^/]*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line): id rises inside a split of a file, block inside a file. Parts of a folder are one file, in the order of their
    numbers."""
    name, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    part = F.regexp_extract(name, _PARTS, 2)
    file = F.when(part != "", F.regexp_extract(name, _PARTS, 1)).otherwise(name)
    block = F.when(part != "", F.shiftleft(part.cast("long"), 40)).otherwise(0) + start
    raw = spark.read.text(path)
    return raw.select(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds pos, from 0 in each file."""
    local = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))  # a row a split
    return lines.withColumn("local", local).join(F.broadcast(before), ["file", "block"]).withColumn("pos", F.col("before") + F.col("local") - 1).drop("local", "before")


def carried(lines: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """lines (file, block, id, ...) with a column for each mark: its last value that isn't null in this line or one before."""
    own = lines.select("*", *[m.alias(f"_{n}") for n, m in marks.items()])
    here = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    last = own.groupBy("file", "block").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("id"))).alias(n) for n in marks])
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("file", "block", *[F.last(n, ignorenulls=True).over(above).alias(f"{n}_above") for n in marks])  # a row a split
    out = own.select("*", *[F.last(f"_{n}", ignorenulls=True).over(here).alias(f"{n}_here") for n in marks]).join(F.broadcast(before), ["file", "block"])
    return out.select(*lines.columns, *[F.coalesce(f"{n}_here", f"{n}_above").alias(n) for n in marks])


def _statements(pieces: DataFrame, step: Column, ends: bool) -> DataFrame:
    """pieces (file, block, id, k, line) -> statements (file, block, id, line) in their order, of a number of pieces each.

    step is true at the last piece of a statement (ends) or at the first one. Pieces of a statement are joined by a
    blank. Only counts of the splits are brought together; block and id are those of the statement's first piece.
    """
    own = pieces.withColumn("step", step.cast("long"))
    here = Window.partitionBy("file", "block").orderBy("id", "k").rowsBetween(Window.unboundedPreceding, 0)
    sizes = own.groupBy("file", "block").agg(F.sum("step").alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))  # a row a split
    number = F.sum("step").over(here) - (F.col("step") if ends else F.lit(0))
    own = own.withColumn("local", number).join(F.broadcast(before), ["file", "block"]).withColumn("statement", F.col("before") + F.col("local"))
    parts = own.groupBy("file", "statement").agg(F.array_sort(F.collect_list(F.struct("block", "id", "k", "line"))).alias("p"))
    return parts.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["id"].alias("id"), F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("line"))


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """(file, pos, line): stripped lines from 0; blank ones and those that start with `comment` are left out, pos counts the rest."""
    own = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    if comment:
        own = own.where(~F.startswith("line", F.lit(comment)))
    return _numbered(own).select("file", "pos", "line")


def all_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) with blank lines."""
    return _numbered(_lines(spark, path)).select("file", "pos", "line")


def tokens(line, separators: str = r"\s+"):
    """Non-empty tokens between any of the separators (a regular expression)."""
    return F.filter(F.split(line, separators), lambda s: s != "")


def reject_pointer(lines: DataFrame) -> DataFrame:
    """Raises if a file is a large-file pointer instead of data."""
    if not lines.where((F.col("pos") == 0) & F.col("line").startswith("version https://git-lfs")).isEmpty():
        raise ValueError("the file is a large-file pointer, not data")
    return lines


def read_hgr(spark: SparkSession, path: str, permissive: bool = False) -> Hypergraph:
    """One .hgr file: header `edges vertices [flag]`, a line of pins for each hyperedge, then vertex weights.

    A flag that ends in 1 puts a weight before the pins; a flag of 10 or more adds vertex weights. % starts a comment.
    Ids are 1-based. A pin out of range or a missing line raises; permissive drops such pins. Repeated pins stay.
    """
    rows = numbered_lines(spark, path, "%").select("pos", tokens("line").alias("t"))
    head = rows.where("pos = 0").first()
    if head is None or len(head.t) < 2:
        raise ValueError(f"{path} has no header")
    m, n, flag = int(head.t[0]), int(head.t[1]), int(head.t[2]) if len(head.t) > 2 else 0
    body = rows.where(f"pos between 1 and {m}")
    weighted = flag % 10 == 1
    edges = body.select(F.col("pos").cast("bigint").alias("e"), (F.col("t")[0].cast("double").cast("bigint") if weighted else F.lit(1).cast("bigint")).alias("hwt"), F.slice("t", 2 if weighted else 1, 1 << 30).alias("p"))
    pins = edges.select("e", F.explode("p").alias("v")).select("e", F.col("v").cast("bigint").alias("v"))
    weights = rows.where(f"pos between {m + 1} and {m + n}").select((F.col("pos") - m).cast("bigint").alias("v"), F.col("t")[0].cast("double").cast("bigint").alias("vwt"))
    vertices = spark.range(1, n + 1).withColumnRenamed("id", "v")
    vertices = vertices.join(weights, "v", "left").select("v", F.coalesce("vwt", F.lit(1)).alias("vwt"), F.lit(None).cast("int").alias("fixed")) if flag >= 10 else vertices.select("v", F.lit(1).cast("bigint").alias("vwt"), F.lit(None).cast("int").alias("fixed"))
    found = edges.count()
    if found < m:
        raise ValueError(f"{path} has {found} of {m} hyperedges")
    wrong = pins.where(f"v is null or v < 1 or v > {n}")
    if permissive:
        pins = pins.where(f"v between 1 and {n}")
    elif not wrong.isEmpty():
        raise ValueError(f"{path} has pins out of 1..{n}")
    return Hypergraph(vertices, edges.select("e", "hwt"), pins)


def read_vector(spark: SparkSession, path: str, name: str = "part") -> DataFrame:
    """One integer a vertex (.fix, .part.K): (v from 1, name); -1 is null."""
    rows = numbered_lines(spark, path)
    return rows.select((F.col("pos") + 1).cast("bigint").alias("v"), F.nullif(tokens("line")[0].cast("int"), F.lit(-1)).alias(name))


def with_fixed(h: Hypergraph, fixed: DataFrame) -> Hypergraph:
    """fixed (v, fixed) put into the vertices."""
    return Hypergraph(h.vertices.drop("fixed").join(fixed, "v", "left").select("v", "vwt", "fixed"), h.hyperedges, h.pins)


def read_embedding(spark: SparkSession, path: str, dimensions: int | None = None) -> DataFrame:
    """(v from 1, coord): blank-separated numbers; raises where a line has not `dimensions` of them."""
    rows = numbered_lines(spark, path).select((F.col("pos") + 1).cast("bigint").alias("v"), tokens("line").cast("array<double>").alias("coord"))
    if dimensions is not None and not rows.where(F.size("coord") != dimensions).isEmpty():
        raise ValueError(f"{path} has lines of another length than {dimensions}")
    return rows


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """`key = value` lines (.dim): (key, value int)."""
    kv = F.split("line", "=")
    return numbered_lines(spark, path).where("line like '%=%'").select(F.trim(kv[0]).alias("key"), F.trim(kv[1]).cast("int").alias("value"))


def sample_cases(spark: SparkSession, pattern: str, regex: str = r"/([^/]+)_ub(\d\d)_run(\d\d)/[^/]*$") -> DataFrame:
    """(case, ub, run, path) of files whose folder is named like case_ubNN_runNN."""
    f = spark.read.format("binaryFile").load(pattern).select("path")
    part = lambda i: F.regexp_extract("path", regex, i)
    return f.select(part(1).alias("case"), part(2).try_cast("int").alias("ub"), part(3).try_cast("int").alias("run"), "path").where("`case` <> ''")


def read_aux(spark: SparkSession, path: str) -> DataFrame:
    """`design : file file ...`: (name, files)."""
    kv = F.split("line", ":", 2)
    return numbered_lines(spark, path, "#").where("line like '%:%'").select(F.trim(kv[0]).alias("name"), tokens(kv[1]).alias("files"))


def read_pl(spark: SparkSession, path: str) -> DataFrame:
    """Placement lines `inst x y bel [FIXED]`: (inst, x, y, bel, state)."""
    t = tokens("line")
    return numbered_lines(spark, path, "#").select(t[0].alias("inst"), t[1].cast("int").alias("x"), t[2].cast("int").alias("y"), t[3].cast("int").alias("bel"), F.get(t, F.lit(4)).alias("state"))


def read_clock_regions(spark: SparkSession, path: str) -> DataFrame:
    """`name xl xr yb yt` lines: (name, xl, xr, yb, yt); other lines are skipped."""
    t = tokens("line")
    rows = numbered_lines(spark, path, "#").where(F.size(t) == 5).where(F.forall(F.slice(t, 2, 4), lambda s: s.rlike("^-?[0-9]+$")))
    return rows.select(t[0].alias("name"), *[t[i + 1].cast("int").alias(c) for i, c in enumerate(("xl", "xr", "yb", "yt"))])


def read_sources_csv(spark: SparkSession, path: str) -> DataFrame:
    """Voltage sources `x,y,edge,voltage`."""
    return spark.read.schema("x int, y int, edge int, voltage double").option("mode", "FAILFAST").csv(path)


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested rule files, one document a file."""
    return spark.read.option("multiLine", True).json(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path_id from 1, vertices): blank-separated vertex ids of a timing path on each line."""
    return numbered_lines(spark, path).select((F.col("pos") + 1).cast("bigint").alias("path_id"), tokens("line").cast("array<bigint>").alias("vertices"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Flat metric files `"key": value`: (pos, key, value) in order, repeated keys kept, quoted numbers unquoted."""
    p = r'^"([^"]+)"\s*:\s*"?([^",]*)"?,?$'
    rows = numbered_lines(spark, path).where(F.col("line").rlike(p))
    return rows.select("pos", F.regexp_extract("line", p, 1).alias("key"), F.regexp_extract("line", p, 2).alias("value"))


def read_net_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks `Net name driver`, then `pin x y` lines up to a blank one: (net, driver, pin, x, y)."""
    t = tokens(F.trim("line"))
    head = F.when(F.get(t, F.lit(0)) == "Net", F.struct(F.get(t, F.lit(1)).alias("net"), F.get(t, F.lit(2)).cast("int").alias("driver"))).when(F.size(t) == 0, F.struct(F.lit(None).cast("string").alias("net"), F.lit(None).cast("int").alias("driver")))
    rows = carried(_lines(spark, path), {"head": head}).where("head.net is not null").select("head.*", t.alias("t")).where("size(t) >= 3 and get(t, 0) <> 'Net'")
    return rows.select("net", "driver", F.col("t")[0].alias("pin"), F.col("t")[1].cast("bigint").alias("x"), F.col("t")[2].cast("bigint").alias("y"))


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """`net`, `(`, `x0 y0 x1 y1 layer` ..., `)`: (net, xlo, ylo, xhi, yhi, layer). The bracket may stand behind the name."""
    t = tokens(F.regexp_replace("line", r"[()]", " "))
    rows = carried(_lines(spark, path), {"net": F.when(F.size(t) == 1, F.get(t, F.lit(0)))}).select("net", t.alias("t")).where("size(t) = 5 and net is not null")
    return rows.select("net", *[F.col("t")[i].cast("bigint").alias(c) for i, c in enumerate(("xlo", "ylo", "xhi", "yhi"))], F.col("t")[4].alias("layer"))


def read_vcd(spark: SparkSession, path: str) -> DataFrame:
    """Value changes: (id, name, t, value). A time holds for the lines up to the next; vectors are `b<bits> id`.

    A $var declaration stands in one line.
    """
    lines = _lines(spark, path).withColumn("line", F.trim("line"))
    var = r"\$var\s+\S+\s+\d+\s+(\S+)\s+(\S+)"
    names = lines.where(F.startswith("line", F.lit("$var"))).select("file", F.regexp_extract("line", var, 1).alias("id"), F.regexp_extract("line", var, 2).alias("name"))
    rows = carried(lines, {"t": F.nullif(F.regexp_extract("line", r"^#(\d+)", 1), F.lit("")).cast("bigint")}).where("t is not null")
    l = F.col("line")
    scalar, vector = l.rlike(r"^[01xzXZ]\S+$"), l.rlike(r"^[bB][01xzXZ]+\s+\S+$")
    rows = rows.where(scalar | vector).select("file", "t", F.when(vector, F.split(l, r"\s+")[1]).otherwise(F.substring(l, 2, 1 << 30)).alias("id"), F.when(vector, F.substring(F.split(l, r"\s+")[0], 2, 1 << 30)).otherwise(F.substring(l, 1, 1)).alias("value"))
    return rows.join(names, ["file", "id"]).select("id", "name", "t", "value")


def read_spef(spark: SparkSession, path: str, coupling_factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Parasitics: (net, total, node, other, cap) and (net, a, b, res); coupling capacitances are scaled by the factor."""
    t = tokens("line")
    section = F.nullif(F.regexp_extract("line", r"^\s*\*(D_NET|CONN|CAP|RES|INDUC|END)\b", 1), F.lit(""))
    head = F.when(t[0] == "*D_NET", F.struct(F.get(t, F.lit(1)).alias("net"), F.get(t, F.lit(2)).cast("double").alias("total")))
    rows = carried(_lines(spark, path), {"section": section, "head": head}).where("head is not null").select("section", "head.*", t.alias("t"))
    coupled = F.size("t") == 4
    caps = rows.where("section = 'CAP' and size(t) in (3, 4)")
    caps = caps.select("net", "total", F.col("t")[1].alias("node"), F.when(coupled, F.col("t")[2]).alias("other"), (F.element_at("t", -1).cast("double") * F.when(coupled, coupling_factor).otherwise(1.0)).alias("cap"))
    res = rows.where("section = 'RES' and size(t) = 4").select("net", F.col("t")[1].alias("a"), F.col("t")[2].alias("b"), F.col("t")[3].cast("double").alias("res"))
    return caps, res


def read_blif(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """inputs, outputs and clocks (name), gates (kind, cell, pins) of a BLIF file; a backslash at a line's end joins the next.

    models (name) and counts (what, n) with the numbers of each.
    """
    lines = _lines(spark, path).withColumn("k", F.lit(0)).withColumn("line", F.rtrim("line")).where("not startswith(ltrim(line), '#')")
    goes_on = F.endswith("line", F.lit("\\"))
    own = lines.withColumn("goes_on", goes_on).withColumn("line", F.regexp_replace("line", r"\\$", ""))
    t = _statements(own, ~F.col("goes_on"), True).select(tokens("line").alias("t")).where("size(t) > 0")
    names = lambda key: t.where(F.col("t")[0] == key).select(F.explode(F.slice("t", 2, 1 << 30)).alias("name"))
    gates = t.where(F.col("t")[0].isin(".gate", ".latch", ".mlatch", ".names")).select(F.substring(F.col("t")[0], 2, 20).alias("kind"), F.get("t", F.lit(1)).alias("cell"), F.slice("t", 3, 1 << 30).alias("pins"))
    what = F.when(F.col("t")[0].isin(".inputs", ".outputs", ".clock"), F.size("t") - 1).when(F.col("t")[0].isin(".gate", ".latch", ".mlatch", ".names", ".model"), 1)
    counts = t.select(F.substring(F.col("t")[0], 2, 20).alias("what"), what.cast("long").alias("n")).where("n is not null").groupBy("what").agg(F.sum("n").alias("n"))
    return {"models": names(".model"), "inputs": names(".inputs"), "outputs": names(".outputs"), "clocks": names(".clock"), "gates": gates, "counts": counts}


def read_def(spark: SparkSession, path: str, sections: tuple[str, ...] = ("COMPONENTS", "ROW", "TRACKS")) -> dict[str, DataFrame]:
    """The asked sections of a DEF file only: components (inst, master, status, x, y, orient), rows, tracks.

    Lines of other sections are left out before anything of them is parsed.
    """
    lines = _lines(spark, path).withColumn("line", F.regexp_replace("line", r"#.*$", ""))
    opened = F.regexp_extract("line", r"^\s*([A-Z]+)\s+\d+\s*;", 1)
    ended = F.regexp_extract("line", r"^\s*END\s+([A-Z]+)", 1)
    section = F.when(opened != "", opened).when(ended != "", F.lit("-"))
    lines = carried(lines, {"section": section}).withColumn("section", F.coalesce("section", F.lit("-")))

    def statements(of: DataFrame) -> DataFrame:
        pieces = of.withColumn("p", F.split("line", ";", -1)).select("file", "block", "id", F.size("p").alias("n"), F.posexplode("p").alias("k", "line"))
        return _statements(pieces, F.col("k") < F.col("n") - 1, True).select(F.trim("line").alias("l"))

    out = {}
    num = r"(-?\d+)"
    if "COMPONENTS" in sections:
        p = rf"^-\s+(\S+)\s+(\S+)[^;]*?(?:\+\s+(PLACED|FIXED|COVER)\s+\(\s*{num}\s+{num}\s*\)\s+(\S+)|\+\s+(UNPLACED)|$)"
        c = statements(lines.where("section = 'COMPONENTS'").where(opened == "")).where("startswith(l, '-')")
        g = lambda i: F.nullif(F.regexp_extract("l", p, i), F.lit(""))
        out["COMPONENTS"] = c.select(g(1).alias("inst"), g(2).alias("master"), F.coalesce(g(3), g(7)).alias("status"), g(4).cast("bigint").alias("x"), g(5).cast("bigint").alias("y"), g(6).alias("orient"))
    outside = statements(lines.where("section = '-'").where(ended == "")) if {"ROW", "TRACKS"} & set(sections) else None
    if "ROW" in sections:
        p = rf"^ROW\s+(\S+)\s+(\S+)\s+{num}\s+{num}\s+(\S+)\s+DO\s+{num}\s+BY\s+{num}(?:\s+STEP\s+{num}\s+{num})?"
        g = lambda i: F.regexp_extract("l", p, i)
        r = outside.where(F.col("l").rlike(p))
        out["ROW"] = r.select(g(1).alias("name"), g(2).alias("site"), g(3).cast("bigint").alias("x"), g(4).cast("bigint").alias("y"), g(5).alias("orient"), g(6).cast("int").alias("nx"), g(7).cast("int").alias("ny"), g(8).try_cast("bigint").alias("step"))
    if "TRACKS" in sections:
        p = rf"^TRACKS\s+([XY])\s+{num}\s+DO\s+{num}\s+STEP\s+{num}(?:\s+LAYER\s+(\S+))?"
        g = lambda i: F.regexp_extract("l", p, i)
        r = outside.where(F.col("l").rlike(p))
        out["TRACKS"] = r.select(g(1).alias("axis"), g(2).cast("bigint").alias("origin"), g(3).cast("bigint").alias("n"), g(4).cast("bigint").alias("step"), g(5).alias("layer"))
    return out


def read_sdf_delays(spark: SparkSession, path: str) -> DataFrame:
    """IOPATH delays of an SDF file: (cell, instance, src, dst, rise, fall), of triples the middle value."""
    lines = _lines(spark, path)
    parts = F.filter(F.split("line", r"(?=\((?:CELL|CELLTYPE|INSTANCE|DELAY|IOPATH|INTERCONNECT|TIMINGCHECK)\b)"), lambda x: F.trim(x) != "")
    pieces = lines.select("file", "block", "id", F.posexplode(parts).alias("k", "line"))
    opens = F.col("line").rlike(r"^\((?:CELL|CELLTYPE|INSTANCE|DELAY|IOPATH|INTERCONNECT|TIMINGCHECK)\b")
    own = _statements(pieces, opens, False).withColumn("line", F.trim("line"))
    cell = F.when(F.startswith("line", F.lit("(CELLTYPE")), F.regexp_extract("line", r'\(CELLTYPE\s+"([^"]*)"', 1))
    instance = F.when(F.startswith("line", F.lit("(INSTANCE")), F.regexp_extract("line", r"\(INSTANCE\s*([^\s)]*)", 1))
    own = carried(own, {"cell": cell, "instance": instance})
    p = r"^\(IOPATH\s+(\S+)\s+(\S+)\s+\(([^)]*)\)(?:\s*\(([^)]*)\))?"
    own = own.where(F.col("line").rlike(p)).withColumnRenamed("line", "l")
    mid = lambda i: F.get(F.split(F.regexp_extract("l", p, i), ":"), F.when(F.contains(F.regexp_extract("l", p, i), F.lit(":")), 1).otherwise(0)).try_cast("double")
    return own.select(F.coalesce("cell", F.lit("")).alias("cell"), F.coalesce("instance", F.lit("")).alias("instance"), F.regexp_extract("l", p, 1).alias("src"), F.regexp_extract("l", p, 2).alias("dst"), mid(3).alias("rise"), mid(4).alias("fall"))


def rule_fields(text, fields: dict[str, str]):
    """A struct of numbers behind keywords of a rule string, e.g. {'PITCH': 'pitch'}; null where a keyword is missing."""
    return F.struct(*[F.regexp_extract(text, rf"\b{k}\s+(-?[0-9.]+)", 1).try_cast("double").alias(n) for k, n in fields.items()])
