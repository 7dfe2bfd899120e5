"""The corpus pipeline on small tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import odd_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    import public_tokenizers as P
    from test_operators import brute_simhash

    from cdcmart.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in cp.STAGES:
        kept = stage(spark, kept, SF)
        seen.append((name, kept, {r.doc_id for r in kept.select("doc_id").collect()}))
    assert [n for n, *_ in seen] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    assert all(df.columns == columns for _, df, _ in seen[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = seen[0][2]
    last = {texts[i]: i for i in sorted(clean)}  # largest id of equal texts
    assert seen[1][2] == set(last.values())
    ids, parent = sorted(seen[1][2]), {}
    prints = {i: brute_simhash(texts[i]) for i in ids}
    for i in ids:
        parent[i] = i
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    assert seen[2][2] == {i for i in ids if parent[i] == i} == seen[3][2] == seen[4][2]
    encoding = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in kept.collect():
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_positions_keep_the_mix_over_many_files(spark):
    import corpus_pipeline as cp

    from cdcmart.llm.common import materialize
    from cdcmart.llm.mixing import BLOCK_ROWS

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    sources = [f"src{s}" for s in range(6) for _ in range(700)]
    docs = spark.createDataFrame([(i, f"text {i} " + "x " * (i % 90), "en", s, None) for i, s in enumerate(sources)], schema)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        mixed = materialize(cp.mix_sources(spark, docs, SF), "stage-mix_sources")
    finally:
        spark.conf.set(coalesce, kept)
    assert len(mixed.inputFiles()) > 1
    made = sorted((r.position, r.source) for r in cp.encode_bytes(spark, mixed, SF).collect())
    assert [p for p, _ in made] == list(range(len(sources)))
    share = {f"src{s}": cp.MIX_WEIGHTS.get(f"src{s}", 1.0) for s in range(6)}
    done, left, total = dict.fromkeys(share, 0), {s: sources.count(s) for s in share}, sum(share.values())
    for at, (_, source) in enumerate(made, 1):
        done[source] += 1
        assert all(abs(done[s] - share[s] / total * at) < BLOCK_ROWS for s in share)
        if done[source] == left[source] // BLOCK_ROWS * BLOCK_ROWS:
            break


def test_positions_of_clashing_and_filtered_tables(spark):
    """Extra columns of any name pass; rows filtered out since the read leave no gap."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    from cdcmart.llm.common import materialize

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 3}", None) for i in range(300)], schema)
    docs = docs.withColumns({c: F.lit("x") for c in ("position", "_path", "_row", "_begin", "path", "at", "row", "n", "ids", "begin", "_toxicity", "last")})
    clean = cp.reject_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and {r[0] for r in clean.select("_toxicity").distinct().collect()} == {"x"}
    mixed = materialize(cp.mix_sources(spark, docs, SF), "mixed")
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in cp.encode_bytes(spark, mixed, SF).orderBy("position").collect()]
    kept = cp.encode_bytes(spark, mixed.where("doc_id % 7 <> 0"), SF).orderBy("position").collect()
    assert sorted(order) == list(range(300)) and [r.position for r in kept] == list(range(len(kept)))
    assert [r.doc_id for r in kept] == [i for i in order if i % 7]
    fresh = cp.encode_bytes(spark, docs.orderBy(F.desc("doc_id")), SF).orderBy("position").collect()
    assert [r.doc_id for r in fresh] == list(range(299, -1, -1))


def test_odd_rows_and_empty_tables(spark):
    import corpus_pipeline as cp

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in odd_rows()], schema)
    for docs, empty in ((odd, False), (odd.limit(0), True)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() == 0) == empty


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(e.oracle_sql()) <= set(names)
