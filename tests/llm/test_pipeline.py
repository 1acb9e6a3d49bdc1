"""Pipeline stages on planted cases, and the registered queries against their SQL."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest tables with planted cases added."""
    out = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = [f"wort{i}x" for i in range(120)]
    near = list(words)
    near[60] = "anders"
    clean = [f"klar{i}y" for i in range(80)]
    rows = [(9001, " ".join(words)), (9002, "  " + "\n".join(words)), (9003, " ".join(near)), (9004, " ".join(clean)), (9005, f"{' '.join(clean[:30])} extra {item} end"), (9006, None), (9007, "")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], docs.schema)
    docs.unionByName(more).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, planted):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        from provena.llm.common import materialise

        docs = materialise(stage(spark, docs, planted), "test")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
    assert {9001, 9002, 9003, 9004, 9005, 9006, 9007} <= kept["toxicity"]
    assert 9001 not in kept["exact_dedup"] and 9002 in kept["exact_dedup"]  # the longer original stays
    assert len({9006, 9007} & kept["exact_dedup"]) == 1
    assert 9002 in kept["minhash_dedup"] and 9003 not in kept["minhash_dedup"]
    assert 9005 not in kept["decontamination"] and {9002, 9004} <= kept["decontamination"]
    assert kept["byte_bpe"] == kept["decontamination"]


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_minhash", "op5_exact_dedup", "op8_substring_dedup", "op10_warc", "secret_base_spans"])
def test_queries_match_sql(spark, name):
    import duckdb

    from provena.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_is_registered():
    from provena.llm import registry

    numbers = sorted(int(m[1]) for n in registry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11))
