"""Files in, files out, and the edge cases of the parsers."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import scoring
from helixframe.plans import files
from helixframe.sources import fasta, tables
from helixframe.streaming import running

TOY = """>first | one | viral | 9 nt
GGCAGAUCU

>second|two
acgt
ACGT N

>third | x>y | z | 0 nt
>first | again | viral | 3 nt
ttt
"""


def test_fasta_file(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(TOY)
    rows = fasta.parse(fasta.read(spark, str(tmp_path / "a.fasta")), ["family", "kind"]).collect()
    got = [(r["name"], r["family"], r["kind"], r["sequence"]) for r in rows]
    assert got == [("first", "one", "viral", "GGCAGAUCU"), ("second", "two", None, "acguACGUN"), ("third", "x>y", "z", ""), ("first", "again", "viral", "uuu")]


def test_last_record_of_a_name(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "name string, sequence string, at int")
    assert {(r["name"], r["sequence"]) for r in fasta.last_by_name(df, "at").collect()} == {("a", "y"), ("b", "z")}


def test_fasta_wrapping(spark, tmp_path):
    df = spark.createDataFrame([("n", "A" * 150), ("m", "C" * 70), ("e", "")], "name string, seq string")
    fasta.write(df, str(tmp_path / "out"), ["name"], "seq", wrap=70)
    back = {r["name"]: r["sequence"] for r in fasta.parse(fasta.read(spark, str(tmp_path / "out"))).collect()}
    assert back == {"n": "A" * 150, "m": "C" * 70, "e": ""}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert max(map(len, lines)) == 70


def test_stockholm(spark, tmp_path):
    text = "# STOCKHOLM 1.0\n#=GF AC RF1\n#=GF ID one\n#=GF TP Gene; snRNA\nx/1 AC-GT\ny/2 A.CGT\n\nx/1 UU\ny/2 UU\n#=GC SS ...\n//\n# STOCKHOLM 1.0\n#=GF AC RF2\nx/1 ACG\ny/1 AC\n//\n"
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write(text)
    rows = fasta.read_stockholm(spark, str(tmp_path / "s.gz"))
    assert {(r["family"], r["family_name"], r["seq_id"], r["aligned"]) for r in rows.collect()} == {("RF1", "one", "x/1", "AC-GTUU"), ("RF1", "one", "y/2", "A.CGTUU"), ("RF2", None, "x/1", "ACG"), ("RF2", None, "y/1", "AC")}
    kept = fasta.alignments(rows).collect()
    assert [(r["family"], r["aligned"], r["width"]) for r in kept] == [("RF1", "AC.GUUU", 7)]


def test_long_stockholm_block(spark, tmp_path):
    n = 3000
    half = lambda text: "\n".join(f"s{i}  {text}{i}" for i in range(n))
    (tmp_path / "s").write_text("".join(f"# STOCKHOLM 1.0\n#=GF AC {a}\n#=GF TP Gene\n{half('AC-')}\n\n{half('.GU')}\n//\n" for a in ("RF1", "RF2")))
    rows = fasta.read_stockholm(spark, str(tmp_path / "s"))
    assert {(r["family"], r["kind"], r["seq_id"], r["aligned"]) for r in rows.collect()} == {(a, "Gene", f"s{i}", f"AC-{i}.GU{i}") for a in ("RF1", "RF2") for i in range(n)}
    # Once a block is lines, its whole text is not looked at again for each of them.
    for df in (rows, rows.groupBy("family", "kind").count()):
        above, generate, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate posexplode")
        assert generate and "#=GF" in below and "#=GF" not in above and "xxhash64" not in above


def test_ungapped_rows_of_one_large_family(spark, tmp_path):
    names = spark.range(3000).selectExpr("id AS p_partkey", "if(id % 3 = 0, 'acg tucked bolt', 'a') AS p_name", "'Brand#1' AS p_brand")
    names.write.parquet(str(tmp_path / "part.parquet"))
    found = files.stockholm_ungapped(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(("Brand#1", "brand#1", f"id{i}", "A" if i % 3 else "ACGUUCNNNNNNU") for i in range(3000))
    above, generate, _ = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate posexplode")
    assert generate and "#=GF" not in above and "xxhash64" not in above


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tn\na\t1\nb\tnan\n")
    df = tables.read_strings(spark, str(tmp_path / "t.tsv"))
    assert df.dtypes == [("id", "string"), ("n", "string")]
    assert [r["x"] for r in df.select(S.number(F.col("n")).alias("x")).collect()] == [1.0, None]
    tables.write_tsv(df, str(tmp_path / "o"))
    assert tables.read_strings(spark, str(tmp_path / "o"), "\t").count() == 2
    assert tables.write_verified(df, str(tmp_path / "p")) == 2


def test_feature_report(spark, tmp_path):
    one = {"feat_idx": 1, "breadth": 2, "families": ["a"], "max_act": 1.5}
    (tmp_path / "r.json").write_text(json.dumps({"specialist_features": [one, {**one, "feat_idx": 2, "max_act": 0.0}], "moderate_features": [{**one, "breadth": 5}, {**one, "feat_idx": 3, "breadth": 12}]}))
    df = tables.feature_table(spark.read.json(str(tmp_path / "r.json"), multiLine=True), most_breadth=9)
    assert [(r["feat_idx"], r["breadth"]) for r in df.collect()] == [(1, 2)]


def test_detected_columns(spark):
    df = spark.createDataFrame([(f"n.{i}A>G", i + 0.5, 2.5 * i, "x", 10**8 + i, i + 1, 141 - i) for i in range(30)], "name string, score double, score_wide double, other string, genomic long, place int, pos int")
    assert tables.detect_columns(df) == {"variant": "name", "position": "pos", "score": "score_wide"}
    assert tables.detect_columns(df.drop("pos"))["position"] == "place" and tables.detect_columns(df.drop("pos", "place"))["position"] is None
    assert tables.detect_columns(df.limit(0)) == {"variant": None, "position": None, "score": None}
    assert tables.usable_variants(df.withColumn("kind", F.lit("Deletion")), ["kind"]).count() == 0


def test_bracket_pairs(spark):
    """Against a stack, with nested, unmatched and mixed brackets."""
    r = random.Random(7)
    texts = ["((..))", "", "(", ")(", "([)]", "a<b>{c}", "))((", None, "(" * 300 + ")" * 300] + ["".join(r.choice("([{<)]}>..") for _ in range(r.randint(1, 60))) for _ in range(60)]

    def partners(s):
        table, waiting = [0] * len(s), []
        for i, c in enumerate(s):
            if c in "([{<":
                waiting.append(i)
            elif c in ")]}>" and waiting:
                table[i], table[waiting[-1]] = waiting[-1] + 1, i + 1
                waiting.pop()
        return table

    found = scoring.pairs(spark.createDataFrame(list(enumerate(texts)), "id int, db string"), ["id"], "db")
    assert "Python" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(i, at, p) for i, t in enumerate(texts) for at, p in enumerate(partners(t or ""), 1)]


def test_clean_edges(spark):
    df = spark.createDataFrame([("",), (None,), ("ac gt ß",), ("NNN",)], "s string").select(S.cleaned(F.col("s")).alias("c"), S.share_of(S.cleaned(F.col("s")), "GC").alias("g"), S.window_starts(F.length("s")).alias("w"))
    assert [r["c"] for r in df.collect()] == ["", None, "ACGUN", "NNN"]
    assert [r["g"] for r in df.collect()] == [0.0, 0.0, 0.4, 0.0]


def test_scorer_errors_are_columns(spark):
    def scorer(seqs):
        if any("N" in s for s in seqs):
            raise ValueError("no N")
        return [[float(len(s))] for s in seqs]

    df = spark.createDataFrame([("AC",), ("AN",)], "seq string").coalesce(1)
    rows = {r["seq"]: (r["vector"], r["error"]) for r in scoring.scored(df, "seq", scorer).collect()}
    assert rows == {"AC": ([2.0], None), "AN": (None, "no N")}


def test_criticality_scores_each_sequence_once(spark, tmp_path):
    def scorer(seqs):
        with open(tmp_path / "texts", "a") as f:
            f.write("".join(f"{s}\n" for s in seqs))
        return [[float(s.count(b)) for b in "ACGU"] if s != "AG" else None for s in seqs]

    rows = [(i, "ACG") for i in range(40)] + [(50, "AU"), (51, ""), (52, None), (None, "ACG"), (60, "AC"), (60, "AC")]
    found = scoring.embedding_criticality(spark.createDataFrame(rows, "k int, seq string"), ["k"], scorer).collect()
    mutants = lambda s: {s[:i] + b + s[i + 1 :] for i in range(len(s)) for b in "ACGU" if b != s[i]}
    texts = (tmp_path / "texts").read_text().split()
    assert sorted(texts) == sorted(x for s in ("ACG", "AU", "AC") for x in (s, *mutants(s)))
    got = {(r["k"], r["pos"]): r["score"] for r in found}
    assert len(found) == len(got) and set(got) == {(k, p) for k in (*range(40), None) for p in (1, 2, 3)} | {(k, p) for k in (50, 60) for p in (1, 2)}
    assert all(v == pytest.approx(2**0.5) for v in got.values())


def test_masked_scan(spark):
    def log_probs(seqs):
        return [[-1.0, -2.0, -3.0, -4.0] for _ in seqs]

    df = spark.createDataFrame([("g", "AU")], "gene string, seq string")
    got = {r["pos"]: r["score"] for r in scoring.masked_criticality(df, ["gene"], log_probs).collect()}
    assert got == {1: pytest.approx(2.0), 2: pytest.approx(-2.0)}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i % 2, float(i % 7) - 2) for i in range(60)], "feat int, label int, x double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running.running_family_max(stream).writeStream.outputMode("complete").format("memory").queryName("running_max").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["feat"], r["label"], r["max_act"]) for r in spark.table("running_max").collect()}
    assert got == {(r["feat"], r["label"], r["max_act"]) for r in running.running_family_max(df).collect()}
    moments = {r["label"]: r for r in running.running_moments(df, "x", ["label"]).collect()}
    want = {r["label"]: r for r in df.groupBy("label").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()}
    assert all(abs(moments[k]["mean"] - want[k]["m"]) < 1e-9 and abs(moments[k]["variance"] - want[k]["v"]) < 1e-9 for k in want)


def test_residues_and_contexts(spark):
    rows = spark.createDataFrame([("F", "a", "A.CG", "ACG"), ("F", "b", ".UCG", "UCG"), ("F", "c", "A.C.", "AC"), ("G", "d", "AA", "AA")], "family string, seq_id string, aligned string, ungapped string")
    got = {(r["seq_id"], r["nth"]): (r["column"], r["letter"]) for r in fasta.residues(rows).where("family = 'F'").collect()}
    assert got[("a", 2)] == (2, "C") and got[("b", 1)] == (1, "U") and len(got) == 8
    queries = spark.createDataFrame([("F", "ACG"), ("F", "GGG")], "family string, ungapped string")
    found = {(r["query"], r["nth"]): r["seq_id"] for r in fasta.contexts(queries, rows, most=1).collect()}
    assert found[("a", 0)] == "a" and found[("a", 1)] in {"b", "c"} and len(found) == 2


def test_resolved_accessions(spark):
    rows = spark.createDataFrame([("RNU4-2", "XR_1", "RNU4 2 gene", 100), ("RNU4-2", "NR_9", "rnu42", 100), ("RNU4-2", "NR_1", "other", 100), ("X", "NR_2", "x", 4000)], "symbol string, accession string, title string, length int")
    assert [(r["symbol"], r["accession"]) for r in tables.resolved(rows).collect()] == [("RNU4-2", "NR_9")]
