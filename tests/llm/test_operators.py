"""The dealt operators against brute force on small tables with odd rows."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import empty_docs, odd_docs, odd_rows, prose  # noqa: E402

from cdcmart.llm import bpe, exact_dedup, fingerprints, mixing, sharding, simhash, substrings, token_store, toxicity, url_filter  # noqa: E402
from cdcmart.llm.components import connected_components  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def with_clashes(df):
    """Columns under names that the operators use inside."""
    return df.withColumns({c: F.lit(c) for c in ("rep", "kind", "h", "uid", "row", "fp", "key", "range", "_bucket", "rank", "keep_id", "shard", "slot", "block")})


@pytest.mark.parametrize("small", [False, True])
def test_exact_dedup(spark, small):
    sizes = {"combine_bytes": 3000, "bucket_bytes": 3000} if small else {}
    rows = exact_dedup.dedup_decisions(with_clashes(odd_docs(spark)), extra=["lang"], **sizes).collect()
    groups = defaultdict(list)
    for i, text, *_ in odd_rows():
        groups[text or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = Counter((i, top[t or ""], len(groups[t or ""])) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == expected
    kept = Counter(r.keep_id for r in rows if r.kept)
    assert sum(kept.values()) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    full = exact_dedup.dedup_rows(with_clashes(odd_docs(spark)), **sizes)
    assert full.columns == with_clashes(odd_docs(spark)).columns
    got = full.collect()
    assert {r.text or "" for r in got} == set(groups) and len(got) == len(groups)
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in odd_rows()}


def test_exact_dedup_empty(spark):
    assert exact_dedup.dedup_decisions(empty_docs(spark)).count() == 0
    assert exact_dedup.dedup_rows(empty_docs(spark)).count() == 0


def test_content_table_compares_whole_texts():
    table = exact_dedup.ContentTable(1 << 20)
    entries = [table.add(7, f"text {i}") for i in range(3000)]  # all of one hash
    assert [table.find(7, f"text {i}") for i in range(3000)] == entries and table.find(7, "other") == -1


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        values = np.sort(rng.integers(0, 1000 * n + 1, n))
        ef = token_store.EliasFano.build(values)
        ef = token_store.EliasFano(ef.n, ef.low_bits, *ef.parts())
        assert (ef.slice(0, n) == values).all()
        for i in rng.integers(0, n, 20) if n else []:
            assert ef.select(int(i)) == values[i]
        bits = 8 * sum(map(len, ef.parts()))
        assert n < 3000 or bits < n * (3.5 + np.log2(1000))


def test_token_store(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    extra = [(50, "it's  a <|endoftext|> test.\n\nNew  line… 12,5% e.g. don't\tstop ", "en", "a"), (51, "x" * 5000, "en", "a")]
    docs = with_clashes(odd_docs(spark).union(spark.createDataFrame(extra, odd_docs(spark).schema)))
    read = token_store.read_store(token_store.write_store(docs, P.path("byte_bpe_50k.json"))).orderBy("start").collect()
    texts = sorted(((i, t or "") for i, t, *_ in [*odd_rows(), *extra]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (i, text) in zip(read, texts, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start) == (i, start) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert token_store.read_store(token_store.write_store(empty_docs(spark), P.path("byte_bpe_50k.json"))).count() == 0


def test_token_store_query_matches_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from cdcmart.llm.queries import op2_token_store

    texts = ["end <|endoftext|> start", "<|endoftext|><|endoftext|>\n a  ", "plain <|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    tokenizer, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for r, text in zip(op2_token_store(spark, f"file://{tmp_path}").orderBy("doc_id").collect(), texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 3)
    rows = fingerprints.neighbour_likeness(with_clashes(odd_docs(spark))).collect()
    texts = sorted(((i if i is not None else -(1 << 63), t or "") for i, t, *_ in odd_rows()), key=lambda x: (-x[0], x[1]))
    expected = Counter()
    for (i, t), (_, nxt) in zip(texts, [*texts[1:], texts[0]], strict=True):
        h = len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_chars, r.edited_sha256) for r in rows) == expected
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert fingerprints.neighbour_likeness(empty_docs(spark)).count() == 0
    one = fingerprints.neighbour_likeness(odd_docs(spark).where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_fingerprint_is_homomorphic(spark):
    docs = spark.createDataFrame([(1, "one.\ntwo.\nthree."), (2, "three.\none.\ntwo."), (3, "one.\ntwo."), (4, "three.")], "doc_id long, text string")
    p = fingerprints.fingerprints(docs)
    d = {r.doc_id: r.d for r in p.select("doc_id", fingerprints.digest(F.col("print")).alias("d")).collect()}
    assert d[1] == d[2] != d[3]
    pair = p.where("doc_id = 3").select(F.col("print").alias("a")).join(p.where("doc_id = 4").select(F.col("print").alias("b")))
    whole = p.where("doc_id = 1").select(F.col("print").alias("w"))
    both = pair.join(whole).select(
        fingerprints.digest(fingerprints.combine(F.col("a"), F.col("b"))).alias("sum"), fingerprints.digest(fingerprints.combine(F.col("w"), F.col("b"), -1)).alias("rest")
    ).first()
    assert (both["sum"], both["rest"]) == (d[1], d[3])


def test_likeness_estimates_shared_sentences(spark):
    base = [prose(i, 6) + "." for i in range(40)]
    docs = spark.createDataFrame([(i, "\n".join(base[: 40 - i] + [prose(1000 + i * 50 + j, 6) + "." for j in range(i)])) for i in (0, 10, 20, 30, 40)], "doc_id long, text string")
    p = fingerprints.fingerprints(docs)
    first = p.where("doc_id = 0").select(F.col("print").alias("first"))
    got = {r.doc_id: r.x for r in p.join(first).select("doc_id", fingerprints.likeness(F.col("print"), F.col("first")).alias("x")).collect()}
    assert got[0] == 1.0 and all(abs(got[i] - (40 - i) / 40) < 0.3 for i in got)


def test_likeness_of_all_documents(spark):
    """Likeness columns against exact multisets of sentences."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (-x[0], x[1]))

    def exact(a, b):
        x, y = (Counter(re.split("\n|(?<=[.!?]) +", t)) for t in (a, b))
        return 1.0 if Counter(a.split("\n")) == Counter(b.split("\n")) else 2 * sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))

    want = {}
    for (i, t), (_, nxt) in zip(texts, [*texts[1:], texts[0]], strict=True):
        want[i] = exact(t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]), exact(t, nxt)
    rows = fingerprints.neighbour_likeness(docs).collect()
    errors = sorted(abs(got - w) for r in rows for got, w in zip((r.near_edited, r.near_next), want[r.doc_id], strict=True))
    assert len(rows) == len(texts) and errors[-1] < 0.25 and errors[int(len(errors) * 0.99)] < 0.15


def test_sharding(spark):
    rows = [(i, f"copy {i % 7}" if i % 3 == 0 else f"text {i}") for i in range(700)] + [(1, "text 1"), (None, None), (None, "")]
    made = sharding.shard_documents(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")), shards=5).collect()
    counts = Counter(r.shard for r in made)
    assert len(made) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s in range(5):
        assert sorted(r.slot for r in made if r.shard == s) == list(range(counts[s]))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in made) == expected
    text = {i: t for i, t in rows if i is not None}
    groups = defaultdict(list)
    for r in made:
        if r.doc_id is not None and text[r.doc_id].startswith("copy"):
            groups[text[r.doc_id]].append(r.shard)
    together = sum(Counter(v).most_common(1)[0][1] for v in groups.values()) / sum(map(len, groups.values()))
    assert together > 0.4  # 0.2 by chance
    assert sharding.shard_documents(empty_docs(spark)).count() == 0


def test_sharding_gathers_groups_of_any_size(spark):
    rows = [f"{n} group {g}" for n, k in ((2, 100), (10, 60), (50, 20), (300, 4)) for g in range(k) for _ in range(n)]
    rows = list(enumerate([*rows, *(f"1 single {i}" for i in range(9000))]))  # room for each group on one shard
    groups, text = defaultdict(Counter), dict(rows)
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups[text[r.doc_id]][r.shard] += 1
    for n in (2, 10, 50, 300):  # share of rows on the shard with most of their group
        own = [c for t, c in groups.items() if t.startswith(f"{n} ")]
        assert sum(max(c.values()) for c in own) / sum(sum(c.values()) for c in own) > 0.9


def test_pfair_mix(spark):
    rows = [(i, "abc"[min(2, i * 7 % 11 // 4)], f"t{i}") for i in range(900)] + [(None, None, "x"), (3, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"a": 2.0, "b": 1.0, "c": 0.5}
    made = mixing.mix(docs, weights, block_rows=10).collect()
    assert sorted(r.position for r in made) == list(range(len(rows)))
    by_slot = {}
    for r in made:
        assert by_slot.setdefault(r.slot, (r.mix_source, r.block)) == (r.mix_source, r.block)
    assert sorted(by_slot) == list(range(len(by_slot)))
    whole = mixing.whole_weights({**weights, "": 1.0})
    total, done = sum(whole.values()), Counter()
    blocks = Counter(s for s, _ in by_slot.values())
    for slot in sorted(by_slot):
        source, block = by_slot[slot]
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[s] - whole[s] * (slot + 1) / total) < 1 for s in whole)
        if done[source] == blocks[source]:
            break
    full = mixing.mixed_rows(docs, weights, block_rows=10)
    assert full.columns == docs.columns and Counter(map(tuple, full.collect())) == Counter(rows)
    assert mixing.mix(empty_docs(spark)).count() == 0
    many = spark.createDataFrame([(i, f"s{i % 400}") for i in range(1000)], "doc_id long, source string")
    assert sorted(r.position for r in mixing.mix(many, {"s1": 3.0}).collect()) == list(range(1000))


def lag(made, weights, default=1.0):
    """The most blocks that any source is ahead of or behind its exact share of
    the slots, until the first source has no block left."""
    order = [s for _, s in sorted({(r.slot, r.mix_source) for r in made})]
    share = {s: Fraction(str(weights.get(s, default))) for s in set(order)}
    total, left, done, most = sum(share.values()), Counter(order), Counter(), 0
    for slot, source in enumerate(order, 1):
        done[source] += 1
        most = max(most, *(abs(done[s] - x * slot / total) for s, x in share.items()))
        if done[source] == left[source]:
            return most


def test_mix_keeps_to_the_given_weights(spark):
    weights = {"src0": 3.0, "src1": 2.0, "src2": 1.5, "src3": 0.5}
    rows = [(i, f"src{s}") for s in range(20) for i in range(int(600 * weights.get(f"src{s}", 1.0)))]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=2).collect()
    assert len(made) == len(rows) and lag(made, weights) < 1
    assert mixing.whole_weights({"a": 0.1, "b": 0.3, "c": 1e-3}) == {"a": 100, "b": 300, "c": 1}


def test_mix_of_many_sources(spark):
    weights = {"s0": 3.0, "s1": 0.5, "s2": 70.1}
    rows = [(i, f"s{s}") for s in range(400) for i in range(2 * (s % 7 + 1 if s > 2 else 900))]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=2).collect()
    assert {r.mix_source for r in made} == {s for _, s in rows} and lag(made, weights) < 1
    assert sorted(r.position for r in made) == list(range(len(rows)))
    for r in made:
        assert r.position // 2 == r.slot  # all blocks are full here


def test_plan_against_fluid_shares():
    rng = np.random.default_rng(3)
    for _ in range(40):
        weights = {f"s{i}": int(a) for i, a in enumerate(rng.integers(1, 150 if _ % 4 == 0 else 9, 12))}
        rows = {s: int(n) for s, n in zip(weights, rng.integers(0, 300, 12), strict=True)}
        blocks = {s: -(-n // 3) for s, n in rows.items()}
        slots, at = {}, {}
        for s, first, stop, a, slot, length, row, per, places, offsets in mixing.plan(weights, rows, 3):
            for b in range(first, stop):
                turn, i = divmod(b - first, a)
                slots[slot + turn * length + places[i]], at[row + turn * per + offsets[i]] = (s, b), min(3, rows[s] - 3 * b)
        assert sorted(slots) == list(range(sum(blocks.values())))
        start = 0
        for first in sorted(at):
            assert first == start
            start += at[first]
        assert start == sum(rows.values())
        done = Counter()
        for slot in range(len(slots)):
            s, b = slots[slot]
            assert b == done[s]
            done[s] += 1
            # virtual time at which all sources together have had so many blocks
            left, v, had = sorted((Fraction(blocks[x], weights[x]), x) for x in weights), Fraction(0), Fraction(0)
            for end, x in left:
                rate = sum(weights[y] for e, y in left if (e, y) >= (end, x))
                if had + (end - v) * rate >= slot + 1:
                    v += (slot + 1 - had) / rate
                    break
                had, v = had + (end - v) * rate, end
            assert all(abs(done[x] - min(blocks[x], weights[x] * v)) < 1 for x in weights)


def test_period_has_less_than_one_block_of_lag():
    for weights in ({"a": 1}, {"a": 7, "b": 2, "c": 1}, {f"s{i}": i % 5 + 1 for i in range(30)}):
        order, total, done = mixing.period(weights), sum(weights.values()), Counter()
        assert Counter(order) == weights
        for t, s in enumerate(order, 1):
            done[s] += 1
            assert all(abs(done[x] - weights[x] * t / total) < 1 for x in weights)


def brute_repeats(rows, length):
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            first[w] = min(first.get(w, 1 << 63), key(i))
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < key(i):
                gone[j : j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept] += 1
    return out


@pytest.mark.parametrize(("length", "chunk"), [(50, 2 << 20), (50, 4000), (8, 900)])
def test_prefix_free_dedup(spark, monkeypatch, length, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    more = [(100 + i, prose(i, 30) + prose(2, 12 + i) + prose(50 + i, 30), "en", "a") for i in range(12)]
    docs = with_clashes(odd_docs(spark).union(spark.createDataFrame(more, odd_docs(spark).schema))).repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in substrings.remove_repeats(docs, length=length).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t, *_ in [*odd_rows(), *more]], length)


def test_prefix_free_dedup_splits_hot_triggers(spark):
    """A line of 28 bytes in every document, with other text around it: one trigger with
    as many phrases as documents, split by window; results stay those of brute force."""
    line = "-- share this page today! --"
    rows = [(i, prose(i, 12) + line + prose(1000 + i % 20, 12), "en", "a") for i in range(120)] + [(200 + i, prose(5, 60), "en", "a") for i in range(40)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema).repartition(6)
    texts = [t.encode() for _, t, *_ in rows]
    parse = substrings.Parse(texts, 50)
    several, more = parse.more_phrases()
    assert more.max() >= 100
    questions = [substrings._question(p.triggers(), np.arange(len(p.triggers())), *p.more_phrases()) for p in (substrings.Parse(texts[i::4], 50) for i in range(4))]
    bits = [np.unpackbits(np.frombuffer(a, np.uint8).reshape(2, -1), axis=1) for a in substrings._answers(questions, 60)]
    assert all(1 <= b[1].sum() <= 3 for b in bits)  # the line's triggers; not those of the copies
    windows = parse.split(several[more >= 60])
    assert len(windows) > 100 and parse.n[np.isin(parse.h, windows)].max() == 1
    expected = brute_repeats([(i, t.encode()) for i, t, *_ in rows], 50)
    for hot in (3, 60, substrings.HOT_PHRASES):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in substrings.remove_repeats(docs, hot_phrases=hot).collect())
        assert got == expected


def test_prefix_free_dedup_empty(spark):
    assert substrings.remove_repeats(empty_docs(spark)).count() == 0


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def test_url_filter(spark):
    canon = '<LINK href="{}" rel=canonical>'
    pages = [
        (1, "http://a.example.org/es/x", None), (2, "https://A.Example.ORG/en/1?q", ""), (3, "http://x.org", ""), (4, "http://x.org/", ""), (5, "http://x.com/de/1", ""),
        (6, "http://notorg/", ""), (7, None, "x"), (8, "no scheme", "x"), (9, "http://x.net/a", canon.format("http://x.com/de/9")), (10, "https://www.x.net/a/#top", ""),
        (11, "http://y.net/b", canon.format("/c") + '<meta http-equiv="refresh" content="0; url=http://z.com/de/1">'), (12, "http://y.net/c", ""),
        (13, "http://w.net/d", canon.format("http://w.com/de/1")), (14, "http://w.com/fr/1", '<meta property="og:url" content="http://w.net/d">'), (15, "http://w.net/d?utm_source=a&ref=b", ""),
        (5, "http://x.com/de/1", ""), (16, "http://x.com.org/fr/", ""), (17, "http://q.net/e?page=2", ""),
    ]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(1)), RULES).collect()
    assert len(got) == len(pages)
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert by == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: ("org/", "allow"), 5: ("com/de/", "block"), 6: (None, "allow"),
        7: (None, "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "block"), 12: (None, "block"),
        13: (None, "allow"), 14: ("com/fr/", "allow"), 15: (None, "allow"), 16: ("org/", "allow"), 17: (None, "allow"),
    }
    hosts = {r.page_id: (r.host, r.path) for r in got}
    assert hosts[2] == ("a.example.org", "/en/1") and hosts[3] == ("x.org", "") and hosts[7] == hosts[8] == ("", "")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_url_filter_decodes_ampersands(spark):
    tags = (
        '<link rel="canonical" href="http://v.net/y?a=1&amp;b=2">', "<meta property='og:url' content='/y?a=1&#38;b=2'>",
        '<meta http-equiv="refresh" content="0; url=/y?a=1&#x26;b=2">', '<link rel="canonical" href="/y?a=1&amp;amp;b=2">',
    )
    pages = [(i, f"http://v.net/{i}", tag) for i, tag in enumerate(tags)] + [(9, "http://v.net/y?a=1&b=2", '<link rel="canonical" href="http://v.com/de/1">')]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "block", 1: "block", 2: "block", 3: "allow", 9: "block"}


def test_url_filter_against_sql(spark):
    """Random pages that link, redirect and vary in spelling, against the SQL statement."""
    import random

    import duckdb

    from cdcmart.llm.queries import ORACLE, URL_RULES

    r = random.Random(11)
    hosts = [f"{lead}s{i}.{end}" for i in range(80) for lead in ("", "www.", "m.") for end in ("com", "net", "net", "info")] + ["example.org", "m.co.uk", "www.com"]

    def url():
        return r.choice(["http://", "https://"]) + r.choice(hosts) + r.choice(["", "/", "/de/1", "/fr/2", "/es/3", "/x/y", "/x/y/"]) + r.choice(["", "", "?p=1", "?utm_a=2&p=1", "#t", "?ref=x"])

    def tag():
        to = r.choice([url(), "/" + r.choice(["de/1", "x/y", "q?p=1&amp;r=2"])])
        return r.choice(['<link rel="canonical" href="{}">', "<LINK href={} rel=canonical>", "<meta property='og:url' content='{}'>", '<meta http-equiv="refresh" content="0; url={}">', '<a href="{}">']).format(to)

    pages = [(i, r.choice([None, "none", *[url() for _ in range(20)]]), r.choice([None, "", tag(), tag(), tag() + "x" + tag()])) for i in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = {tuple(x) for x in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE['op7_url_filter']})").fetchall()}
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {tuple(x) for x in rows} == want and len(rows) == len(pages)
    by_alias = [x for x in rows if x.rule is None and x.verdict == "block"]
    assert len(by_alias) >= 10


def test_references_resolve_as_rfc_3986(spark):
    """The normal and abnormal examples of section 5.4 (bases with a host), and more."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
        "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
        "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g",
        "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
        "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
        "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x", "mailto:x": "mailto:x",
        "https://h/a/../b?u=1": "https://h/b?u=1", "/go?u=http://x/y": "http://a/go?u=http://x/y",
    }
    made = spark.createDataFrame([(r,) for r in cases], "r string").select("r", url_filter.resolve(F.col("r"), F.lit(base)).alias("u")).collect()
    assert {x.r: x.u for x in made} == cases
    got = spark.createDataFrame([("x",), ("../x",)], "r string").select(url_filter.resolve(F.col("r"), F.lit("http://h")).alias("u")).collect()
    assert [x.u for x in got] == ["http://h/x", "http://h/x"]


def test_url_filter_links_names_and_ties(spark):
    canon = '<link rel=canonical href="{}">'
    pages = [
        (1, "http://a.net/x/y?b=1", canon.format("?page=2")), (2, "http://a.net/x/y?page=2", canon.format("http://z.com/de/1")), (3, "http://a.net/x/q/r", canon.format("../y?page=2")),
        (4, "http://a.net/o", '<base href="/deep/er/">' + canon.format("../p")), (5, "http://a.net/deep/p", canon.format("http://z.com/de/2")),
        (6, "http://m.com/b", canon.format("http://z.com/de/3")), (7, "http://www.com/b", ""), (8, "http://m.co.uk/b", canon.format("http://z.com/de/4")), (9, "http://co.uk/b", ""),
        (10, "http://m.site.net/b", canon.format("http://z.com/de/5")), (11, "http://www.site.net/b", ""),
    ]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    blocked = {r.page_id for r in got if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 5, 6, 8, 10, 11}
    ties = (("allow", "t.net", "/ab"), ("block", "x.t.net", "/"), ("block", "t.net", "/ab"))
    one = spark.createDataFrame([(1, "http://x.t.net/abc", "")], "page_id long, url string, html string")
    assert url_filter.judge(one, ties).first().verdict == "allow"


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 1), (300, 299), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 100)
    more = [(60, "don't 12abc34 ...!!'s x  y\n\n z" * 50 + "é" * 300 + "1" * 300, "en", "a")]
    docs = with_clashes(odd_docs(spark).union(spark.createDataFrame(more, odd_docs(spark).schema)))
    encoding = bpe.load(RANKS, P.PATTERN)
    rows = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    expected = Counter((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in [*odd_rows(), *more])
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in rows) == expected
    assert bpe.encode(empty_docs(spark), RANKS, P.PATTERN).count() == 0
    text = more[0][1]
    assert "".join(bpe.pieces(text, 10)) == text
    assert [x for p in bpe.pieces(text, 10) for x in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def brute_simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "_BLOCK", 500)
    base = prose(9, 900)
    near = [(200 + i, base + f" tail{i}", "en", "a") for i in range(40)]
    rows = [*odd_rows(), *near]
    docs = with_clashes(odd_docs(spark).union(spark.createDataFrame(near, odd_docs(spark).schema)))
    got = simhash.near_duplicates(docs, tile=tile).collect()
    prints = [brute_simhash(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for n, (i, *_) in enumerate(rows):
        ids[root(n)].append(i)
    least = {c: min((i for i in m if i is not None), default=None) for c, m in ids.items()}
    expected = Counter((i, prints[n], least[root(n)]) for n, (i, *_) in enumerate(rows))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == expected
    assert sum(r.first for r in got) == len(ids)
    firsts = simhash.first_rows(docs, tile=tile)
    assert firsts.columns == docs.columns and firsts.count() == len(ids)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_toxicity(spark):
    bad = ["scumling", "trashy"]
    rows = [(i, prose(i, 40) + (f" {bad[i % 2]} and {bad[(i + 1) % 2]}" if i % 5 == 0 else ""), 1 if i % 5 == 0 else 0) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, ""), (9001, "x " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: (r.score, r.held) for r in toxicity.score(docs.withColumn("score", F.lit(2)), model).withColumn("held", toxicity.held_out()).collect()}
    assert len(scored) == 603 and all(0 <= s <= 1 for s, _ in scored.values())
    test = [(scored[i][0] >= 0.5, y) for i, _, y in rows if scored[i][1]]
    assert len(test) > 80 and sum(p == bool(y) for p, y in test) / len(test) > 0.97
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (_, held) in scored.items() if i is not None)
    assert scored[9000][0] == scored[None][0] < 0.5
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(empty_docs(spark), none).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())


def test_toxicity_fit_against_plain_risk(spark):
    """The fit against a dense restatement of feature choice, risk and steps."""
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice(["sun", "moon", "tree", "river"]) for _ in range(9)) + (" foulest" * r.randrange(1, 4) if i % 4 == 0 else "") for i in range(60)]
    made = [toxicity.features(t) for t in texts]
    positive, unlabelled, prior, steps = made[::4][:8], made, 0.3, 25
    model = toxicity.fit(positive, unlabelled, prior, steps=steps)
    every = sorted({int(s) for x in made for s in x})
    n_p, n_u = len(positive), len(unlabelled)
    chosen = []
    for s in every:
        p, u = sum(s in x for x in positive) / n_p, sum(s in x for x in unlabelled) / n_u
        if abs(p - u) >= max(toxicity.MIN_EFFECT, toxicity.MIN_Z * ((u + 1 / n_p) / n_p) ** 0.5):
            chosen.append(s)
    x = np.array([[float(s in f) for s in chosen] + [1.0] for f in [*positive, *unlabelled]])
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m = v = np.zeros(len(w))
    for step in range(1, steps + 1):
        def risk(w):
            z = x @ w
            pos, as_clean = np.logaddexp(0, -z[:n_p]).mean(), np.logaddexp(0, z)
            rest = as_clean[n_p:].mean() - prior * as_clean[:n_p].mean()
            return (prior * pos + rest if rest >= 0 else -rest) + toxicity.DECAY / 2 * (w[:-1] ** 2).sum()

        g = np.array([(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert len(chosen) >= 3 and np.flatnonzero(model.weights).tolist() == chosen
    assert np.abs(model.weights[chosen] - w[:-1]).max() < 1e-2 and abs(model.bias - w[-1]) < 1e-2


def test_toxicity_takes_any_ids(spark):
    """Text ids, and rows that repeat an id with other texts in any order."""
    rows = [(f"d{i % 150}", prose(i, 20) + (" scumling" * 2 if i % 150 % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(f"d{i}", int(i % 5 == 0)) for i in range(150)], "doc_id string, toxic int")
    models = [toxicity.train(spark.createDataFrame(x, "doc_id string, text string").repartition(n), labels) for n, x in ((1, rows), (7, rows[::-1]))]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all() and models[0].weights.any()


def test_toxicity_does_not_read_held_out_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(100)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    b = a.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    m, n = toxicity.train(docs, a), toxicity.train(docs, b)
    assert m.bias == n.bias and (m.weights == n.weights).all()
