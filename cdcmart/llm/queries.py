"""Registered queries of the training-data operators.

Each ``opN_*`` applies its operator with production parameters to the whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.sources.tables import load

from . import (
    bpe,
    chat_format,
    exact_dedup,
    fingerprints,
    lexical_search,
    mixing,
    sharding,
    simhash,
    substrings,
    token_store,
    toxicity,
    url_filter,
    vector_codes,
)

#: Target shares of the mix; sources without a share of their own count 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 1.5, "src3": 0.5}

#: (verdict, host, path) of the URL filter.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    made = exact_dedup.dedup_decisions(docs, extra=["text_sha256"])
    return made.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id shards of all documents, written and read back."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    manifest = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    read = token_store.read_store(manifest)
    return read.select(
        "doc_id", "start", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of its sources."""
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS).select("doc_id", "source", "block", "slot", "position")


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with likeness."""
    made = fingerprints.neighbour_likeness(_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.digest(F.col("print")).alias("fingerprint"),
        fingerprints.digest(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal counts that keep copies together."""
    made = sharding.shard_documents(_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 50 bytes of earlier documents."""
    made = substrings.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules and by its aliases."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids and of the bytes they decode to."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    read = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    made = simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; crc32 fold 0 is held out of training."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: The conversation that joins the table: control strings and backslashes in both turns.
PLANTED = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation through the template and back: turns, loss mask, length."""
    said = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], said.schema)
    return chat_format.digests(chat_format.format_conversations(said.unionByName(more)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every usable vector."""
    codes, books = vector_codes.code_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical_search.search(_documents(spark, sf_dir).select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_store": op2_token_store,
    "op5_pfair_mix": op5_pfair_mix,
    "op3_multiset_fingerprint": op3_multiset_fingerprint,
    "op4_label_propagation": op4_label_propagation,
    "op6_prefix_free_dedup": op6_prefix_free_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": op12_vector_codes,
    "op13_lexical_search": op13_lexical_search,
}

def _page_sql() -> str:
    """Statement of the URL filter: rules, edges and, by a recursive CTE, components.
    Targets with a scheme and those from the root are resolved; other references (none
    in the given pages, which declare no targets at all) are not."""

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path(url: str) -> str:
        return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

    def rule(field: str, url: str) -> str:
        rows = ", ".join(f"({n}, '{v}', '{h}', '{p}')" for n, (v, h, p) in enumerate(URL_RULES))
        fits = f"({host(url)} = h OR ends_with({host(url)}, '.' || h)) AND starts_with({path(url)}, p)"
        return f"(SELECT arg_max({field}, length(h || p) * 100 - n) FROM (VALUES {rows}) AS r(n, v, h, p) WHERE {fits})"

    def plain(url: str) -> str:
        h = host(url)
        alias = rf"regexp_matches({h}, '^(www|m)\.[^.]+\.[^.]') AND NOT regexp_matches({h}, '^(www|m)\.(ac|co|com|edu|gov|net|org)\.[a-z]{{2}}(:\d+)?$')"
        parts = rf"string_split(regexp_extract({url}, '(?s)^[^#?]*\?([^#]*)', 1), '&')"
        kept = f"array_to_string(list_filter({parts}, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&')"
        short = rf"CASE WHEN {alias} THEN regexp_replace({h}, '^(www|m)\.', '') ELSE {h} END"
        return f"'//' || {short} || regexp_replace({path(url)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"

    attribute = r"""\s*=\s*["'']?([^"''\s>]+)"""
    return rf"""
        WITH RECURSIVE tags AS (
            SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')
        ), targets AS (
            SELECT url, regexp_replace(CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref{attribute}', 1)
                        WHEN regexp_matches(tag, '(?i)\bproperty\s*=\s*["'']?og:url\b') THEN regexp_extract(tag, '(?is)\bcontent{attribute}', 1)
                        WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl{attribute}', 1) END, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g') AS ref
            FROM tags
        ), links AS (
            SELECT url, CASE WHEN contains(ref, '://') THEN ref ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || ref END AS target
            FROM targets WHERE contains(ref, '://') OR (starts_with(ref, '/') AND NOT starts_with(ref, '//'))
        ), edges AS (
            SELECT url AS a, {plain("url")} AS b FROM pages WHERE contains(url, '://')
            UNION SELECT url, target FROM links UNION SELECT target, {plain("target")} FROM links
        ), ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reached AS (SELECT a AS node, a AS label FROM ways UNION SELECT ways.b, reached.label FROM reached JOIN ways ON reached.node = ways.a),
        component AS (SELECT node, min(label) AS label FROM reached GROUP BY node),
        decided AS (
            SELECT label, bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false) AS blocked
            FROM (SELECT label, {rule("v", "u")} AS own FROM (SELECT label, CASE WHEN starts_with(node, '//') THEN 'http:' || node ELSE node END AS u FROM component))
            GROUP BY label
        )
        SELECT page_id, {host("url")} AS host, {path("url")} AS path, {rule("h || p", "url")} AS rule,
               coalesce({rule("v", "url")}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
        FROM pages LEFT JOIN component ON node = url LEFT JOIN decided USING (label)
    """


def _codes_sql(rounds: int) -> str:
    """Statement of the vector codes: one assignment and one move a round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
            SELECT r, p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d) AS d
            FROM (SELECT r, p, e, x, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT) AS d
                  FROM cut JOIN book{n} USING (p))
            GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(moved, c) AS c FROM book{n} LEFT JOIN (
                SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS moved
                FROM (SELECT p, e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n
                      FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM near{n}) GROUP BY p, e, j)
                GROUP BY p, e) USING (p, e))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS MATERIALIZED (
            SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS parts(p)
        ), book0 AS MATERIALIZED (
            SELECT p, e, x AS c
            FROM cut JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64) USING (r)
        ), {", ".join(steps)}, coded AS (
            SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (r)
    """


ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op7_url_filter": _page_sql(),
    "op11_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ') + length(regexp_replace(role, '\\|### |</turn>|:', '\\\0', 'g')) + length(': ')
                        + length(regexp_replace(text, '\\|### |</turn>', '\\\0', 'g')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM said GROUP BY conv_id
    """,
    "op12_vector_codes": _codes_sql(2),
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, * FROM documents)
        ), asked AS (
            SELECT DISTINCT q, item_id, term
            FROM (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                  FROM (SELECT row_number() OVER () AS q, * FROM benchmark))
        ), lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
        totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
        tfs AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tfs, totals GROUP BY term
        ), scores AS (
            SELECT q, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (r), totals
            GROUP BY q, item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 50
    """,
}
