import gzip

from pyspark.sql import functions as F

from netloom.sources import sinks, text


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_vectors_and_embeddings(spark, tmp_path):
    assert rows(text.read_vector(spark, put(tmp_path, "a.fix", "-1\n0 \n1\n"), "fixed").orderBy("v")) == [(1, None), (2, 0), (3, 1)]
    assert rows(text.read_embedding(spark, put(tmp_path, "a.emb", "1 2\n3 4.5\n"), 2).orderBy("v"))[1] == (2, [3.0, 4.5])
    assert rows(text.read_key_values(spark, put(tmp_path, "a.dim", "num_parts = 2\n"))) == [("num_parts", 2)]
    with gzip.open(tmp_path / "b.fix.gz", "wt") as f:
        f.write("1\n0\n")
    assert text.read_vector(spark, str(tmp_path / "b.fix.gz")).count() == 2


def test_placement_formats(spark, tmp_path):
    assert rows(text.read_aux(spark, put(tmp_path, "d.aux", "# c\ndesign : a.nodes a.nets\n"))) == [("design", ["a.nodes", "a.nets"])]
    assert rows(text.read_pl(spark, put(tmp_path, "d.pl", "i1 1 2 3 FIXED\ni2 4 5 6\n"))) == [("i1", 1, 2, 3, "FIXED"), ("i2", 4, 5, 6, None)]
    assert rows(text.read_clock_regions(spark, put(tmp_path, "f.clk", "BEGIN\nR0 0 10 0 20\nEND\n"))) == [("R0", 0, 10, 0, 20)]
    assert rows(text.read_sources_csv(spark, put(tmp_path, "v.csv", "1,2,3,1.1\n"))) == [(1, 2, 3, 1.1)]
    assert rows(text.read_paths(spark, put(tmp_path, "p.paths", "1 2 3\n4\n")))[0] == (1, [1, 2, 3])


def test_samples_by_folder(spark, tmp_path):
    for d in ("x_ub10_run01", "x_ub10_run02", "other"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "nodes.txt").write_text("0")
    out = text.sample_cases(spark, str(tmp_path / "*" / "nodes.txt")).select("case", "ub", "run")
    assert sorted(rows(out)) == [("x", 10, 1), ("x", 10, 2)]


def test_metrics_keep_order_and_repeats(spark, tmp_path):
    m = text.read_metrics(spark, put(tmp_path, "m.json", '{\n  "a": 1,\n  "b": "2.5",\n  "a": 1e+39\n}\n'))
    assert [(r.key, r.value) for r in m.orderBy("pos").collect()] == [("a", "1"), ("b", "2.5"), ("a", "1e+39")]
    special = spark.createDataFrame([(0, "x", "NaN"), (1, "y", "Infinity"), (2, "z", "3"), (3, "s", 'a"b')], "pos int, key string, value string")
    assert sinks.metrics_json(special).first().json == '{\n  "x": "NaN",\n  "y": "Infinity",\n  "z": 3,\n  "s": "a\\"b"\n}'


def test_nets_and_guides(spark, tmp_path):
    out = text.read_net_blocks(spark, put(tmp_path, "n.txt", "Net n1 0\np1 1 2\np2 3 4\n\nNet n2 1\nq 5 6\n"))
    assert rows(out) == [("n1", 0, "p1", 1, 2), ("n1", 0, "p2", 3, 4), ("n2", 1, "q", 5, 6)]
    g = text.read_guides(spark, put(tmp_path, "g.guide", "n1\n(\n0 0 10 10 metal1\n0 0 10 20 metal2\n)\nn2\n(\n1 1 2 2 metal1\n)\n"))
    assert g.count() == 3
    assert sinks.guide_lines(g).where("net = 'n2'").first().line == "n2\n(\n1 1 2 2 metal1\n)"


def test_vcd(spark, tmp_path):
    body = "$timescale 1ns $end\n$var wire 1 ! clk $end\n$var wire 4 # bus [3:0] $end\n$enddefinitions $end\n#0\n0!\nb0001 #\n#5\n1!\n#10\n0!\nbx1 #\n"
    out = text.read_vcd(spark, put(tmp_path, "a.vcd", body))
    assert sorted(rows(out)) == [("!", "clk", 0, "0"), ("!", "clk", 5, "1"), ("!", "clk", 10, "0"), ("#", "bus", 0, "0001"), ("#", "bus", 10, "x1")]


def test_spef_and_sdf(spark, tmp_path):
    body = '*SPEF "x"\n*D_NET n1 1.5\n*CONN\n*I a I\n*CAP\n1 n1:1 1.0\n2 n1:1 n2:1 0.5\n*RES\n1 n1:1 n1:2 3.0\n*END\n'
    caps, res = text.read_spef(spark, put(tmp_path, "a.spef", body), coupling_factor=2.0)
    assert rows(caps.select("node", "other", "cap")) == [("n1:1", None, 1.0), ("n1:1", "n2:1", 1.0)]
    assert rows(res) == [("n1", "n1:1", "n1:2", 3.0)]
    sdf = '(DELAYFILE (CELL (CELLTYPE "INV") (INSTANCE u1) (DELAY (ABSOLUTE (IOPATH A Y (0.1:0.2:0.3) (0.4))))))'
    assert rows(text.read_sdf_delays(spark, put(tmp_path, "a.sdf", sdf))) == [("INV", "u1", "A", "Y", 0.2, 0.4)]


def test_blif_and_def(spark, tmp_path):
    b = text.read_blif(spark, put(tmp_path, "a.blif", ".model m\n.inputs a \\\n b\n.outputs y\n.gate INV A=a Y=y\n.end\n"))
    assert rows(b["inputs"]) == [("a",), ("b",)] and rows(b["gates"]) == [("gate", "INV", ["A=a", "Y=y"])]
    d = "ROW r0 site 0 0 N DO 10 BY 1 STEP 380 0 ;\nTRACKS X 190 DO 5 STEP 380 LAYER m1 ;\nCOMPONENTS 2 ;\n- u1 INV + PLACED ( 10 20 ) N ;\n- u2 BUF ;\nEND COMPONENTS\n"
    out = text.read_def(spark, put(tmp_path, "a.def", d))
    assert sorted(rows(out["COMPONENTS"])) == [("u1", "INV", "PLACED", 10, 20, "N"), ("u2", "BUF", None, None, None, None)]
    assert rows(out["ROW"]) == [("r0", "site", 0, 0, "N", 10, 1, 380)] and rows(out["TRACKS"]) == [("X", 190, 5, 380, "m1")]
    assert set(text.read_def(spark, str(tmp_path / "a.def"), ("ROW",))) == {"ROW"}
    place = spark.createDataFrame([("u1", 5, 6, True), ("u2", 7, 8, False)], "inst string, nx long, ny long, macro boolean")
    moved = sinks.moved_components(out["COMPONENTS"], place, 2)
    assert sorted(rows(sinks.def_components(moved)))[0] == ("u1", "- u1 INV + PLACED ( 7 8 ) N ;")


def test_rule_fields(spark):
    out = spark.range(1).select(text.rule_fields(F.lit("PITCH 1.5 FIRSTLASTPITCH 2 ;"), {"PITCH": "p", "FIRSTLASTPITCH": "f", "X": "x"}).alias("s")).select("s.*")
    assert rows(out) == [(1.5, 2.0, None)]


def test_sample_sinks(spark, tmp_path):
    h = text.read_hgr(spark, put(tmp_path, "a.hgr", "2 3\n1 2\n2 3\n"))
    sinks.write_sample(h, h.pins, str(tmp_path / "s"))
    read = lambda n: [r.value for r in spark.read.text(str(tmp_path / "s" / n)).collect()]
    assert read("nodes.txt") == ["0 1.0 1", "1 1.0 2", "2 1.0 1"]
    assert read("hedges.txt") == ["0; 0 1; 0", "1; 1 2; 0"]
    assert [r.line for r in sinks.metis_lines(h).orderBy("id").collect()] == ["3 2 001", "2 1", "1 1 3 1", "2 1"]
    sinks.write_vector(spark.createDataFrame([(2, None), (1, 1)], "v long, part int"), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["1", "-1"]


def test_ordered_text_is_written_and_read_in_parts(spark, tmp_path):
    """No task gets all lines, and parts, also those of several splits, are numbered as one file."""
    lines = spark.range(4000).selectExpr("id", "concat('line ', id) line")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        sinks.ordered_text(lines, ["id"], str(tmp_path / "o"))
        assert len(list((tmp_path / "o").glob("part-*"))) > 1
        got = text.all_lines(spark, str(tmp_path / "o")).orderBy("pos").collect()
        assert [(r.pos, r.line) for r in got] == [(i, f"line {i}") for i in range(4000)] and len({r.file for r in got}) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_files_are_read_by_splits(spark, tmp_path):
    """Split after every few bytes: places, times, nets and sections hold across splits."""
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" if i % 3 else f"# {i}\n" for i in range(400)))
    (tmp_path / "a.vcd").write_text("$var wire 1 ! clk $end\n$enddefinitions $end\n" + "".join(f"#{10 * i}\n" + f"{i % 2}!\n" * (i % 4) for i in range(300)))
    (tmp_path / "a.spef").write_text("".join(f"*D_NET n{i} {i}.5\n*CONN\n*I n{i}:1 I\n*CAP\n" + "".join(f"{j} n{i}:{j} 0.5\n" for j in range(i % 5)) + f"*RES\n1 n{i}:1 n{i}:2 3.0\n*END\n" for i in range(100)))
    (tmp_path / "a.blif").write_text(".model m\n.inputs \\\n" + "".join(f" i{i} \\\n" for i in range(90)) + " i90\n" + "".join(f"# c {i} \\\n.gate INV \\\n  A=i{i}\\\n Y=o{i}\n" for i in range(91)) + ".end\n")
    (tmp_path / "a.sdf").write_text("(DELAYFILE\n" + "".join(f'(CELL (CELLTYPE "C{i % 3}")\n (INSTANCE u{i})\n (DELAY (ABSOLUTE\n' + "".join(f"(IOPATH A{j}\n Y (0.1:{j}.5:9)\n ({i}))\n" for j in range(i % 4)) + ")))\n" for i in range(60)) + ")\n")
    (tmp_path / "a.def").write_text(
        "".join(f"ROW r{i} site 0 {i} N\n DO 10 BY 1 STEP 380 0 ;\n" for i in range(30)) + "COMPONENTS 80 ;\n" + "".join(f"- u{i} INV\n + PLACED ( {i}\n {2 * i} ) N ;" + "\n" * (i % 2) for i in range(80))
        + "\nEND COMPONENTS\nNETS 50 ;\n" + "".join(f"- n{i} ( u{i} A )\n + ROUTED m1 ( 1 2 ) ;\n" for i in range(50)) + "END NETS\nTRACKS X 190\n DO 5 STEP 380 LAYER m1 ;\nEND DESIGN\n"
    )
    (tmp_path / "a.guide").write_text("".join(f"n{i}" + ("\n(\n" if i % 2 else " (\n") + "".join(f"0 0 {i} {j} m{j}\n" for j in range(i % 5)) + ")\n" for i in range(120)))
    (tmp_path / "a.nets").write_text("".join(f"Net n{i} {i % 3}\n" + "".join(f"p{j} {i} {j}\n" for j in range(i % 6)) + "\n" for i in range(120)) + "stray 1 2\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("600", "1"), strict=True):
            spark.conf.set(k, v)
        lines = text.numbered_lines(spark, str(tmp_path / "a.txt"), "#")
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 4
        assert [(r.pos, r.line) for r in lines.orderBy("pos").collect()] == list(enumerate(f"line {i}" for i in range(400) if i % 3))
        assert [r.pos for r in text.all_lines(spark, str(tmp_path / "a.txt")).orderBy("pos").collect()] == list(range(400))
        got = sorted((r.t, r.value) for r in text.read_vcd(spark, str(tmp_path / "a.vcd")).collect())
        assert got == sorted((10 * i, str(i % 2)) for i in range(300) for _ in range(i % 4))
        caps, res = text.read_spef(spark, str(tmp_path / "a.spef"))
        assert sorted((r.net, r.total, r.node) for r in caps.collect()) == sorted((f"n{i}", i + 0.5, f"n{i}:{j}") for i in range(100) for j in range(i % 5))
        assert sorted((r.net, r.res) for r in res.collect()) == sorted((f"n{i}", 3.0) for i in range(100))
        blif = text.read_blif(spark, str(tmp_path / "a.blif"))
        assert {r.name for r in blif["inputs"].collect()} == {f"i{i}" for i in range(91)}
        assert sorted(r.pins for r in blif["gates"].collect()) == sorted([f"A=i{i}", f"Y=o{i}"] for i in range(91))
        assert {r.what: r.n for r in blif["counts"].collect()} == {"model": 1, "inputs": 91, "gate": 91}
        got = sorted(tuple(r) for r in text.read_sdf_delays(spark, str(tmp_path / "a.sdf")).collect())
        assert got == sorted((f"C{i % 3}", f"u{i}", f"A{j}", "Y", j + 0.5, float(i)) for i in range(60) for j in range(i % 4))
        out = text.read_def(spark, str(tmp_path / "a.def"))
        assert sorted(tuple(r) for r in out["COMPONENTS"].collect()) == sorted((f"u{i}", "INV", "PLACED", i, 2 * i, "N") for i in range(80))
        assert sorted((r.name, r.y, r.step) for r in out["ROW"].collect()) == sorted((f"r{i}", i, 380) for i in range(30)) and out["TRACKS"].count() == 1
        got = sorted(tuple(r) for r in text.read_guides(spark, str(tmp_path / "a.guide")).collect())
        assert got == sorted((f"n{i}", 0, 0, i, j, f"m{j}") for i in range(120) for j in range(i % 5))
        got = sorted(tuple(r) for r in text.read_net_blocks(spark, str(tmp_path / "a.nets")).collect())
        assert got == sorted((f"n{i}", i % 3, f"p{j}", i, j) for i in range(120) for j in range(i % 6))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
