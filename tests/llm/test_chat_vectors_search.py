import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cdcmart.llm import chat_format, chat_template, lexical_search, vector_codes
from cdcmart.llm.chat_format import ChatFormat
from cdcmart.llm.chat_template import Filter, If, Lit, Name, Output, Print, Template, TemplateError, Text, escaper, fold, parse, unescape
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, prose

# --- templates ----------------------------------------------------------------


def render(source, messages=(), **context):
    return Template(source + "{% for m in messages %}{% endfor %}", ("</s>",)).render(list(messages), **context).text()


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("{{ 1 + 2 * 0 if false else 'a' ~ 3 }}", None),  # no multiplication
        ("{{ 'a' ~ 1 + 2 }}", "a3"), ("{{ 7 // 2 - 1 }}{{ -7 % 3 }}", "22"), ("{{ 'x' in 'axb' and not false }}", "true"),
        ("{{ 1 if none else 2 }}", "2"), ("{% if a == 'q' %}A{% elif a %}B{% else %}C{% endif %}", "B"), ("a {#- no -#} b", "a  b"),
        ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"), ("{{ d.k[1] }}{{ d['z'] is defined }}{{ zz is not defined }}", "20falsetrue"),
        ("{{ zz | default('n') }}{{ a | upper }}{{ ' t ' | trim | length }}", "nBB1"), ("{% set b = a ~ '!' %}{{ b }}", "bb!"),
        ("{% for x in d.k %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "110,220"), ("{{ 'p\\n\\'' }}", "p\n'"),
        ("{{ '</s>\\\\' | escape }}", "\\</s>\\\\"), ("{{ a < 'c' and 2 >= 1 and 'k' not in d.k }}", "true"), ("{{ none }}", ""),
    ],
)
def test_template_language(source, expected):
    context = {"a": "bb", "d": {"k": [10, 20]}}
    if expected is None:
        with pytest.raises(TemplateError):
            render(source, **context)
    else:
        assert render(source, **context) == expected


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__ }}", "{{ a() }}", "{{ m }}", "{{ d.k.append }}", "{{ 'a' * 3 }}", "{% import x %}", "{% if a %}", "{{ a | nofilter }}", "{{ 1 + 'a' }}",
     "{{ 1 // 0 }}", "{{ messages }}", "{% for x in a %}{% endfor %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{{ d }}", "{{ a b }}", "{{ 'a }}"],
)
def test_template_sandbox(source):
    with pytest.raises(TemplateError):
        render(source, a="x", d={"k": [1]})


def test_template_needs_its_loop():
    for source in ("no loop", "{% for m in messages %}{{ messages }}{% endfor %}", "{% for m in messages %}{% endfor %}" * 2):
        with pytest.raises(TemplateError):
            Template(source)


def test_constants_are_folded():
    escape = escaper(("</s>",))
    tree = fold(parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 1 %}c{{ x | default('q') }}{% else %}d{% endif %}{% if x %}{{ '</s>' | escape }}{% elif true %}e{% elif y %}f{% endif %}"), escape)
    assert tree == (Text("ab2c"), Print(Filter("default", Name("x"), (Lit("q"),))), If(((Name("x"), (Text("\\</s>"),)),), (Text("e"),)))
    assert fold(parse("{{ false and x }}{{ true and x }}{{ not (2 > 3) }}"), escape) == (Text("false"), Print(Name("x")), Text("true"))


def test_escaping_is_reversible():
    escape, r = escaper(("</turn>", "### ")), random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["\\", "</turn>", "### ", "<", "#", " ", "a", "/turn>", "é", "\n"]) for _ in range(r.randrange(12)))
        assert unescape(escape(text)) == text
        assert not re.search("</turn>|### ", re.sub(r"\\.", "\0", escape(text), flags=re.S))


def test_generation_spans():
    out = Template("{% for m in messages %}<{% generation %}{{ m }}{% endgeneration %}>{% endfor %}").render(["ab", "", "é"])
    assert out.text() == "<ab><><é>" and out.spans == [(1, 3), (5, 5), (7, 8)]
    assert isinstance(out, Output)


CHATS = "conv_id long, turn long, role string, text string, formatted int, part int, _role int, _key string, n_turns int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4) for r in rows], CHATS)


def odd_chats():
    tricky = r"\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 0, None, None), (2, 0, None, None), (2, None, "assistant", "null turn"), (3, 5, "assistant", ""),
        (None, 0, "user", "none"), (None, 1, "assistant", "answer"), (4, 1, "a:b\\ ### ", "role"), (4, 0, "assistant", "x </turn>\n### user: y"), (5, -300, "system", "s"),
        (5, 300, "assistant", "🙂" * 5000), (5, 1, "user", "</turn"), (6, 2, "assistant", "b"), (6, 2, "assistant", "a"), (6, 2, "user", "a"), (6, 2, "user", "</turn>" * 50),
    ]
    return rows + [(7, i, "user" if i % 2 else "assistant", f"turn {i} \\" + prose(i, i % 9)) for i in range(1500)] + [(8, 3, "assistant", f"same {i % 40}") for i in range(700)]


def said(rows):
    """Turns of every conversation in their defined order."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in held.items()}


@pytest.mark.parametrize("part_chars", [1 << 22, 300])
def test_chat_format(spark, part_chars):
    fmt = ChatFormat(template="<s>{{ 'x' }}" + chat_format.TEMPLATE + "</s>", generation_prompt=True, part_chars=part_chars)
    parts = chat_format.format_conversations(chats(spark, odd_chats()).repartition(5), fmt)
    expected = said(odd_chats())
    held = defaultdict(list)
    for r in parts.collect():
        held[r.conv_id].append(r)
    assert set(held) == set(expected)
    for conv, turns in expected.items():
        mine = sorted(held[conv], key=lambda r: r.part)
        whole = Template(fmt.template, fmt.controls()).render([{"role": r, "text": t} for r, t in turns], add_generation_prompt=True)
        assert "".join(r.formatted for r in mine) == whole.text()
        assert [r.part for r in mine] == [sum(x.turns for x in mine[:i]) for i in range(len(mine))] and {r.n_turns for r in mine} == {len(turns)}
        loss = [unescape(r.formatted[s.begin : s.end]) for r in mine for s in r.loss_spans]
        assert loss == [t for r, t in turns if r == "assistant"]
    assert len(held[7]) >= (6 if part_chars > 300 else 100)  # stretches of 256 turn numbers, or parts
    read = defaultdict(list)
    for r in chat_format.read_turns(parts, fmt).collect():
        read[r.conv_id].append((r.place, r.role, r.text))
    assert {c: [t[1:] for t in sorted(v)] for c, v in read.items()} == expected
    got = {r.conv_id: r for r in chat_format.digests(parts, fmt).collect()}
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(p.formatted) for p in held[conv])


def test_chat_format_edges(spark):
    assert chat_format.digests(chat_format.format_conversations(chats(spark, []))).count() == 0
    long_text = "é</turn>\\" * 300_000
    got = chat_format.digests(chat_format.format_conversations(chats(spark, [(1, 0, "assistant", long_text)]))).collect()
    assert got[0].loss_chars == len(long_text) and got[0].loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    for closing in ("aa", "", "x\\"):
        with pytest.raises(TemplateError):
            ChatFormat(closing=closing).compile()


# --- vector codes ---------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) <= vector_codes.LARGEST for x in r[1])]
    if not kept:
        return [], []
    sizes = Counter(len(r[1]) for r in kept)
    length = max(sizes, key=lambda n: (sizes[n], n))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept if len(v) == length]
    width = -(-length // parts)
    cut = [[(v + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[assign(p, x[p])[1]].append(x[p])
            moved.append([[sum(c) // len(c) for c in zip(*groups[n], strict=True)] if n in groups else e for n, e in enumerate(books[p])])
        books = moved
    out = []
    for (i, _, label), x in zip(kept, cut, strict=True):
        near = [assign(p, x[p]) for p in range(parts)]
        out.append((i, bytes(n for _, n in near).hex(), sum(d for d, _ in near), label))
    errors = Counter()
    for _, _, e, label in out:
        errors[label] += e
    return [(i, c, e, errors[label]) for i, c, e, label in out], books


VECTORS = "vec_id long, embedding array<float>, label int, code string, _label int, v int, error string"


@pytest.mark.parametrize(("entries", "dims", "wide", "broadcast"), [(8, 12, False, True), (64, 10, True, False)])
def test_vector_codes(spark, monkeypatch, entries, dims, wide, broadcast):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 100 if broadcast else 0)
    r = random.Random(dims)
    scale = 100_000.0 if wide else 0.05
    rows = [(i % 90, [float(np.float32(r.gauss(0, scale))) for _ in range(dims)], r.choice([None, 1, 1, 2])) for i in range(150)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] * dims, 1), (203, [float("nan")] * dims, None), (204, [float("inf")] * dims, 2), (205, [1e30] * dims, 2),
             (None, rows[0][1], 3), (206, [0.5], 1), (-1, [0.0] * dims, 4), (-1, [0.0] * dims, 4)]
    table = spark.createDataFrame([(*x, "c", 1, 2, "e") for x in rows], VECTORS).repartition(3)
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.code_vectors(table, 4, 257, 1)
    codes, books = vector_codes.code_vectors(table, 4, entries, 2, cells=entries * 16)
    expected, want = brute_codes(rows, 4, entries, 2)
    assert books.entries.tolist() == want
    got = [(x.vec_id, bytes(x.code).hex(), x.error, x.label_error) for x in codes.collect()]
    assert Counter(got) == Counter(expected)
    flat = ",".join(str(c) for part in want for e in part for c in e)
    assert books.sha256() == hashlib.sha256(flat.encode()).hexdigest()
    row = vector_codes.decode(codes, books).where("vec_id = 5").first()
    whole = [c for p, n in enumerate(row.code) for c in want[p][n]]
    assert row.v == whole[:dims]


def test_vector_codes_without_rows(spark):
    codes, books = vector_codes.code_vectors(spark.createDataFrame([(1, None, 2, "c", 1, 2, "e")], VECTORS))
    assert books is None and codes.count() == 0 and codes.columns == ["vec_id", "label", "code", "error", "label_error"]


# --- lexical search -------------------------------------------------------------


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -low) for rank, (low, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_terms_of_bytes(monkeypatch):
    monkeypatch.setattr(lexical_search, "CHUNK", 7)
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice(["a", "Z", "0", "é", "É", "\x85", "\u3000", "漢", "_", "-", " ", "\n", "\x7f", "@", "[", "`", "{", "/", ":"]) for _ in range(r.randrange(40)))
        assert lexical_search.term_counts(text.encode()) == (len(terms_of(text)), Counter(t.encode() for t in terms_of(text)))


@pytest.mark.parametrize(("leaf", "tree", "task", "block"), [(64, 16_384, 1 << 22, 1 << 20), (2, 60, 2_000, 400)])
def test_lexical_search(spark, monkeypatch, leaf, tree, task, block):
    for name, value in {"TASK_COUNTS": task, "BLOCK_BYTES": block}.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows = odd_rows() + [(1000 + i, prose(i % 150, 5 + i % 60), "en", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema).selectExpr("*", "1 AS n", "2 AS terms", "3 AS score", "4 AS rank")
    items = [(1, prose(7, 30)), (2, None), (3, ""), (4, "ONE-two 漢字"), (5, "notfound at all"), (None, "alpha1 beta2"), (6, "start " * 9), (7, prose(1, 300)), (7, "mu3"), (8, "alpha1 beta2")]
    table = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in lexical_search.search(docs, table, k=20, leaf=leaf, tree_docs=tree).select("item_id", "rank", "doc_id", "score").collect()]
    assert Counter(got) == Counter(brute_search([r[:2] for r in rows], items, 20))
    assert lexical_search.search(empty_docs(spark), table).count() == 0
    assert lexical_search.search(docs, table.where("item_id = 99")).count() == 0


def test_ball_bounds_hold_and_prune():
    r = np.random.default_rng(3)
    dims, n = 400, 3_000
    centres = [r.choice(dims, 12, replace=False) for _ in range(40)]
    per_row = [np.unique(np.concatenate([centres[i % 40], r.choice(dims, 3)])) for i in range(n)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in per_row])])
    term = np.concatenate(per_row)
    whole = r.integers(700_000, 1_000_000, len(term))
    rows = lexical_search._Rows(at, term, whole.astype(np.float64), whole, np.arange(n))
    tree = lexical_search.BallTree(rows, dims, leaf=32)
    assert sorted(np.concatenate([x.doc for x in tree.leaves.values()])) == list(range(n))
    opened = 0
    for q in range(30):
        terms = centres[q]
        weights = r.integers(1, 3_000, len(terms)).astype(np.float64)
        dense = np.zeros(dims, np.int64)
        dense[terms] = weights.astype(np.int64)
        scores = rows.sums(dense[rows.term] * rows.whole)
        bounds = tree.bounds(terms, weights)
        for node, leaf in tree.leaves.items():
            assert scores[leaf.doc].max() <= bounds[node]
        best, seen = 0, []
        for bound, leaf in tree.best_first(bounds):
            seen.append(bound)
            if bound < best:
                break
            opened += 1
            best = max(best, scores[leaf.doc].max())
        assert best == scores.max() and seen == sorted(seen, reverse=True)
    assert opened < 30 * len(tree.leaves)  # some are pruned


# --- token store ----------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_units_end_where_matches_end(monkeypatch, block):
    """The ids of odd texts, in blocks and stretches of any size, are the library's."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cdcmart.llm import token_store

    monkeypatch.setattr(token_store, "BLOCK_BYTES", block)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, mine, r = Tokenizer.from_file(path), token_store.UnitEncoder(path, True), random.Random(block)
    marks = ["a", "B", "é", "×", "÷", "ÿ", "c3", " ", "  ", "\n", "\t", " ", "　", ".", ",", "!", "'s", "'", "1", "-", "漢", "🙂", "́", "_", "\u0085", "​", "(", "\r\n", ";", ":"]
    texts = ["".join(r.choice([*marks, "<|endoftext|>"]) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", "x" * 5000, "word " * 3000, "".join(r.choice(marks) for _ in range(9000))]
    pieces, got = [], []
    for ids in mine.texts(pa.array(texts)):
        if ids is not None:
            pieces += ids.tolist()
        else:
            got.append(pieces)
            pieces = []
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and not pieces
