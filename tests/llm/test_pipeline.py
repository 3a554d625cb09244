import corpus_pipeline as pipeline
import models
from pyspark.sql import functions as F

from tarnweave.llm import decontaminate


def test_stages_against_models(spark, tmp_path):
    rows = list({i: (i, t) for i, t in models.corner_rows(3)}.values())
    leak = " ".join(f"q{i}" for i in range(40))
    rows += [(700, "fine " + leak + " and " + " ".join(f"z{i}" for i in range(60))), (701, " ".join(f"y{i}" for i in range(80)) + " mail me@site.org")]
    rows += [(702, " ".join([*(f"x{i}" for i in range(1500)), *leak.split()[3:16], *(f"v{i}" for i in range(500))]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = dict(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    left = set(text)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        got = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            measured = {i: models.quality(text[i]) for i in left}
            left = {i for i, (n, chars, symbols, _, again) in measured.items() if n >= 50 and 100 * again <= 50 * n and 10 * symbols <= 4 * n and 2 * n <= chars <= 40 * n}
        elif name == "near_duplicates":
            classes = models.near_classes([(i, text[i]) for i in left])
            left = {i for i in left if classes[i][0] == i}
        elif name == "benchmark_decontamination":
            found = models.leaks([(i, text[i]) for i in left], [(1, leak)])
            left = {i for i, (n, hit, _) in found.items() if not hit}
            assert 700 not in left and 702 not in left
        elif name == "personal_data":
            clean = {r.doc_id: r for r in docs.collect()}
            assert clean[701].text.endswith("mail <email>") and clean[701].n_chars == len(clean[701].text)
        assert got == left
        assert k == len(pipeline.STAGES) - 1 or docs.columns == columns
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == left


def test_passages_are_cut_from_long_documents(spark):
    """A long document with a short passage stays without it, also where the cut makes another one."""
    leak = [f"q{i}" for i in range(40)]
    w = [f"z{i}" for i in range(500)]
    texts = [
        " ".join(w[:300]) + ", " + " ".join(leak[:14]).title() + "! " + " ".join(w[300:]),
        " ".join([*w[:300], *leak[20:27], *leak[:14], *leak[27:36], *w[300:]]),
        " ".join(w),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(leak)), (2, "p " * 20)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.cut_passages(docs, bench).collect()}
    assert got[0].text == " ".join(w[:300]) + ", ! " + " ".join(w[300:])
    assert got[1].text.split() == w and got[2].text == texts[2]


def test_passages_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 20)
    leak, other, w = [f"q{i}" for i in range(20)], [f"p{i}" for i in range(20)], [f"z{i}" for i in range(700)]
    docs = spark.createDataFrame([(1, " ".join([*w[:300], *leak[:7], *other[:14], *leak[7:16], *w[300:]])), (2, None)], "doc_id long, text string")
    for items in ((leak, other), (other, leak)):
        bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").coalesce(1)
        got = {r.doc_id: r.text for r in decontaminate.cut_passages(docs, bench).collect()}
        assert got[1].split() == w and got[2] is None
