"""Operators that map each text alone, against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import common, decontaminate, html_text, packing, quality, quality_rules, token_counts, token_files
from motifmill.llm.features import LINE_FEATURES, line_features

WORDS = "the of and to in is that for it on with as at by from was are be this have".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ".", ",", "\n"])) for _ in range(n))


def corpus(spark, extra=()):
    """Nulls, empty, blank, long and repeated texts, and columns whose names clash."""
    rng = random.Random(5)
    long = text(rng, 30_000)
    rows = [(1, text(rng, 60)), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, text(rng, 8)), (6, text(random.Random(9), 8)), (None, "null id text"), (7, "one"), (8, "É ü ı 中文 and the of"), (8, "É ü ı 中文 and the of"), *extra]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, n_words string, k1 int").repartition(3)
    return df, rows


# --- decontamination ----------------------------------------------------------


def _words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def _contamination(t, items, window=10):
    words, hit, found = _words(t), set(), set()
    for item, it in items:
        w = _words(it)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(1, text(rng, 25)), (2, "The OF, and!"), (30, None), (4, "--"), (5, text(rng, 10)), (5, "weird wörd"), (12, "the of and")]
    extra = [(20, "x " + items[0][1].upper()[:90] + " y"), (21, items[4][1].replace(" ", "--")), (22, "A wEird, wörd"), (23, "bathe of and")]
    df, rows = corpus(spark, extra)
    rows = [r for r in rows if r[0] != 5]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, spans int")
    for block in (1 << 19, 40):
        out = decontaminate.digest(decontaminate.decontaminate(df.where("doc_id is null or doc_id <> 5"), bench, block_bytes=block))
        got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())
        want = []
        for i, t in rows:
            n, h, f = _contamination(t, items)
            want.append((i or -1, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0))
        assert got == sorted(want)


def test_decontamination_spans_are_places_in_the_original(spark):
    df = spark.createDataFrame([(1, "Ünd: 'THE, OF; and' zz")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "the of and")], "item_id int, text string")
    (r,) = decontaminate.decontaminate(df, bench).collect()
    assert [r["spans"][0]["first"], r["spans"][0]["past"]] == [6, 18] and "Ünd: 'THE, OF; and' zz"[6:18] == "THE, OF; and"
    assert decontaminate.decontaminate(df, bench.limit(0)).first()["n_hit"] == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(df, bench, max_broadcast_bytes=3)


# --- token counts -------------------------------------------------------------


def _best(word, pieces):
    """Tokens of the best segmentation, by plain dynamic programming."""
    word = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + token_counts.BYTE_PENALTY * size, best[end - 1][1] + size)]
        for at in range(end - 1, -1, -1):
            if word[at:end] in pieces:
                options.append((best[at][0] + pieces[word[at:end]], best[at][1] + 1))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(spark):
    pieces = {token_counts.MARK: -4.0, "t": -3.0, "h": -3.1, "e": -2.9, "th": -2.5, "the": -2.2, token_counts.MARK + "the": -1.1, "o": -2.0, "of": -2.1, "n": -2.7, "an": -2.3, "É": -6.0, "and": -2.05}
    df, rows = corpus(spark)
    got = sorted((r["doc_id"] or -1, r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(df, pieces).collect())
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    known = {w: _best(w, pieces) for _, t in rows for w in split(t)}
    assert got == sorted((i or -1, len(split(t)), sum(known[w] for w in split(t))) for i, t in rows)


def test_trie_scores_shared_prefixes_once_and_long_words():
    counter = token_counts.TrieCounter({"a": -1.0, "aa": -1.5, token_counts.MARK: -1.0}, limit=2)
    words = {b"aaaa", b"aaab", b"aaa", b"a" * 50_000}
    got = counter.count(words)
    assert counter.nodes_scored == 50_000 + 1 + 1
    assert got[b"a" * 50_000] == 25_001 and got[b"aaa"] == 3 and got[b"aaab"] == 4
    again = counter.count({b"aaab", b"aab"})
    assert again[b"aaab"] == 4 and again[b"aab"] == 3


def test_token_counts_are_near_those_of_the_model():
    """The scores by rank stand in for trained ones: whole texts get nearly the model's number of tokens."""
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.TrieCounter(token_counts.vocabulary(path))
    rng = random.Random(4)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=rng.randint(2, 9))).decode() for _ in range(3000)]
    texts = [" ".join(rng.choices(WORDS + words, k=200)) for _ in range(20)]
    mine = sum(counter.count(set(t.encode().split()))[w] for t in texts for w in t.encode().split())
    assert abs(mine / sum(len(model.encode(t)) for t in texts) - 1) < 0.05


# --- quality classifier -------------------------------------------------------


def _quality_rows(n=240):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        t = text(rng, 40)
        rows.append((k, t if k % 2 else re.sub(r"\s", "### ", t), k % 2))
    return rows


def test_machine_equals_pairwise_sum():
    model = quality.train([t.encode() for _, t, _ in _quality_rows(40)], np.array([y for *_, y in _quality_rows(40)], float), buckets=64, rank=3)
    index, values, starts = model.encode([b"the of and of", b""])
    raw, _ = quality.forward(model.bias, model.linear, model.factors, index, values, starts)
    for r in range(2):
        x = np.zeros(len(model.linear))
        np.add.at(x, index[starts[r] : starts[r + 1]], values[starts[r] : starts[r + 1]])
        own = [(i, v) for i, v in zip(index[starts[r] : starts[r + 1]], values[starts[r] : starts[r + 1]])]
        want = model.bias + sum(model.linear[i] * v for i, v in own)
        want += sum(float(model.factors[a] @ model.factors[b]) * u * v for k, (a, u) in enumerate(own) for b, v in own[k + 1 :])
        assert abs(raw[r] - want) < 1e-4


def test_quality_learns_and_scores_all_rows(spark):
    rows = _quality_rows()
    docs, _ = corpus(spark)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t, _ in rows], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i + 100, y) for i, _, y in rows] + [(None, 1), (9999, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).withColumn("held_out", quality.held_out()).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    known = {i + 100: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held) and len(held) > 20
    assert np.mean([(r["score"] >= 0.7) == (known[r["doc_id"]] == 1) for r in held]) > 0.95
    same = [r["score"] for r in out if r["doc_id"] in (2, 3)]
    assert len(same) == 2 and same[0] == same[1]
    flat = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(3), flat).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_training_reads_whole_texts(spark):
    rng = random.Random(6)
    start = "the same beginning " * 700  # over 13,000 characters
    rows = [(k, start + ("plain words " if k % 2 else "### !!! ") * rng.randint(300, 400), k % 2) for k in range(80)]
    rows.append((81, None, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    own = sorted(r["doc_id"] for r in labels.where(~quality.held_out()).collect())
    by = {i: ((t or "").encode(), y) for i, t, y in rows}
    model, want = quality.fit(docs, labels), quality.train([by[i][0] for i in own], np.array([by[i][1] for i in own], float))
    assert np.array_equal(model.edges, want.edges) and np.array_equal(model.linear, want.linear) and np.array_equal(model.factors, want.factors)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs.where("text is not null"), model).collect()}
    assert all((out[i] >= 0.7) == (y == 1) for i, t, y in rows if t)
    lines = [t for t, _ in by.values()] + [b"one\n\n  \ntwo!!! ### | | |\none\n"]
    for t, bits in zip(lines, quality_rules.packed(lines)[0].to_pylist()):
        assert np.array_equal(quality_rules.unpacked(bits), line_features(quality_rules.content_lines(t))[0])


# --- quality rules ------------------------------------------------------------


def _rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_base_rules_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a " * 30, "x y\n" * 20, "É# *\nÉ# *\n"] + [text(rng, n) for n in (7, 8, 9, 50)] + [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    for t in texts:
        assert quality_rules.base_counts((t or "").encode()) == _rules(t), t


def test_viterbi_and_gradient_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    field = quality_rules.LineField(rng.normal(size=(LINE_FEATURES, 2)), rng.normal(size=(2, 2)))
    x = rng.integers(0, 2, size=(5, LINE_FEATURES)).astype(float)

    def score(f, y):
        e = x @ f.emission
        return sum(e[k, s] for k, s in enumerate(y)) + sum(f.transition[a, b] for a, b in zip(y, y[1:]))

    best = max(product((0, 1), repeat=5), key=lambda y: score(field, y))
    assert tuple(field.viterbi(x)) == best and len(field.viterbi(x[:0])) == 0
    y, mask = np.array([[0, 1, 1, 0, 1, 0, 0]]), np.array([[1.0] * 5 + [0] * 2])
    padded = np.concatenate((x, np.ones((2, LINE_FEATURES))))[None]

    def likelihood(f):
        return score(f, tuple(y[0, :5])) - np.log(sum(np.exp(score(f, z)) for z in product((0, 1), repeat=5)))

    fit, g_e, g_t = quality_rules.gradient(field, padded, y, mask)
    assert abs(fit - likelihood(field)) < 1e-9
    for part, g in (("emission", g_e), ("transition", g_t)):
        for at in [(0, 0), (1, 1)]:
            moved = quality_rules.LineField(field.emission.copy(), field.transition.copy())
            getattr(moved, part)[at] += 1e-5
            assert abs((likelihood(moved) - likelihood(field)) / 1e-5 - g[at]) < 1e-3


def test_field_learns_from_whole_sequences():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, size=(12, 70, LINE_FEATURES)).astype(np.float32)
    x[:, :, 7] = 0
    x[::2, 60:, 7] = 1  # the only trace of bad texts lies past the 48th line
    y = [1 - k % 2 for k in range(12)]
    field = quality_rules.train_field(list(x), y)
    assert field.emission[7, 1] - field.emission[7, 0] > 1
    # Sequences of unlike lengths: the gradient is that of one padded batch.
    pairs = [(rows[:n], label) for rows, label, n in zip(x, y, (1, 2, 3, 5, 9, 17, 33, 48, 49, 64, 65, 70))]
    full, labels, mask = np.zeros((12, 70, LINE_FEATURES)), np.zeros((12, 70), np.int64), np.zeros((12, 70))
    for k, (rows, label) in enumerate(pairs):
        full[k, : len(rows)], labels[k, : len(rows)], mask[k, : len(rows)] = rows, label, 1
    want, groups = quality_rules.gradient(field, full, labels, mask), quality_rules._by_length(pairs)
    assert len(groups) > 3 and sum(len(g[0]) for g in groups) == 12 and sum(g[2].sum() for g in groups) == mask.sum()
    for k in (1, 2):
        assert np.allclose(sum(len(g[0]) * quality_rules.gradient(field, *g)[k] for g in groups) / 12, want[k], atol=1e-9)


def test_rules_keep_clean_and_drop_boilerplate(spark):
    rows = _quality_rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    field = quality_rules.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int"))
    out = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, field).collect()}
    assert np.mean([out[i] == (y == 1) for i, _, y in rows]) > 0.95
    edge, given = corpus(spark)
    got = quality_rules.apply_rules(edge, field).collect()
    assert len(got) == len(given) and not any(r["kept"] for r in got if r["n_words"] < 20)
    assert all(quality_rules.train_field([], []).viterbi(line_features([b"a b", b"###"])[0]) == 0)


def test_field_marks_planted_lines_of_mixed_documents(spark):
    rng = random.Random(11)
    noise = lambda: rng.choice([" ".join(w + "###" for w in rng.choices(WORDS, k=9)), " | ".join(rng.choices(WORDS, k=8)), " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=9))])
    rows, truth = [], {}
    for k in range(300):
        good = k % 3 > 0
        lines = [(" ".join(rng.choices(WORDS, k=rng.randint(8, 25))) + ".", 0) for _ in range(rng.randint(6, 10) if good else 3)]
        for _ in range(rng.randint(0, 2) if good else rng.randint(7, 12)):
            lines.insert(rng.randint(0, len(lines)), (noise(), 1))
        rows.append((k, "\n".join(x for x, _ in lines), int(good)))
        truth[k] = np.array([y for _, y in lines])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    field = quality_rules.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int"))
    marks = {i: field.viterbi(line_features(quality_rules.content_lines(t.encode()))[0]) for i, t, _ in rows}
    assert np.mean(np.concatenate([marks[i] == truth[i] for i in truth])) > 0.97
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, field).collect()}
    mixed = [i for i in truth if 0 < truth[i].sum() < len(truth[i])]
    assert len(mixed) > 100 and sum(0 < out[i]["n_content_lines"] < out[i]["n_lines"] for i in mixed) > 0.95 * len(mixed)
    assert all(out[i]["n_content_lines"] == (marks[i] == 0).sum() for i in truth)
    assert np.mean([out[i]["kept"] == bool(y) for i, _, y in rows if not out[i]["base_failed"]]) > 0.95


def test_weak_labels_of_lines():
    a, b = [np.zeros((n, LINE_FEATURES), np.float32) for n in (4, 3)]
    a[1, 7] = b[2, 11] = 1
    ids = lambda *x: np.array(x, np.uint64)
    others = [np.zeros((3, LINE_FEATURES), np.float32)] * 2
    got = quality_rules.weak_labels([a, b, *others], [ids(1, 2, 3, 9), ids(4, 5, 5), ids(6, 7, 9), ids(6, 8, 9)], [1, 0, 0, 1])
    assert [x.tolist() for x in got] == [[0, 1, 0, 1], [0, 0, 1], [0, 0, 1], [1, 1, 1]]
    copies = quality_rules.weak_labels([others[0]] * 3, [ids(1, 2, 3)] * 3, [0, 0, 0])
    assert not np.concatenate(copies).any()


def test_rules_of_an_empty_table(spark):
    df, _ = corpus(spark)
    out = quality_rules.apply_rules(df.limit(0), quality_rules.train_field([], []))
    assert out.count() == 0 and out.columns[:9] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"]


# --- HTML ---------------------------------------------------------------------

PAGES = {
    "<p>One<p>Two <b>bold</b><br>x": "One\n\nTwo bold\nx",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li value=7>y</ol>": "- a\n- b\n  - c\n- d\n\n3. x\n7. y",
    "<table><tr><th>Name<th>Qty<tr><td>kiwi fruit<td>12<tr><td colspan=2>all</table>": "Name       | Qty\nkiwi fruit | 12\nall",
    "a<div hidden>no</div><div style='color:red;display : none'>no</div><template>no</template>b": "ab",
    "<title>no</title><style>p{}</style><script>var a='</p><p>no'</script>yes<noscript>no</noscript>": "yes",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "x &lt;b&gt; &amp;amp; &copy;": "x <b> &amp; ©",
    "a < b <!-- no --> c <![CDATA[no]]> <a href='x>y'>d</a>": "a < b c d",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<p>kept <a href='never ends": "kept",
    "<div>a</span></p>b</div></div>c": "a\n\nb\nc",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>": "in | ner | out",
    "<blockquote>q<blockquote>r</blockquote></blockquote><dl><dt>t<dd>d</dl>": "  q\n\n    r\n\nt\n  d",
    "": "",
}


def test_html_rendering():
    for page, want in PAGES.items():
        assert html_text.html_text(page) == want, page


def test_html_stray_quotes_are_ordinary_characters():
    for page, want in {
        "a<img alt=Bob's>b": "ab",
        "<p class=it's>one<p>don't<p>two": "one\n\ndon't\n\ntwo",
        "<p it's \"x>one</p><p a\"hidden>two</p>it's": "one\n\ntwo\n\nit's",
        "<p title='a>b' \"class=\"x>y\" z>one</p>two": "one\n\ntwo",
        "a<p title = \"x>'y\">b": "a\n\nb",
        "a<i title=>b</i><i hidden=>no</i><i =\"x>c</i>": "abc",
        "a<i x=/b/>c<i title=\"d\"e='>'>f": "acf",
        "a<i title=\"never ends>b": "a",
        "a<i title = 'never ends>b": "a",
        "a<i title=": "a",
    }.items():
        assert html_text.html_text(page) == want, page
    for page in ("<a b= '" * 20_000, "<a " + "b" * 200_000, "<a " + "b= " * 100_000, "<a" + " " * 200_000, "<a b" + " " * 200_000 + "'" * 200_000):
        html_text.html_text(page)


def test_html_shows_svg_math_xmp_and_inputs():
    for page, want in {
        "a<svg><title>no</title><desc>no</desc><defs/><path d=M0/ /><style/><text>b</text><text>c</text></svg>d": "a b c d",
        "<svg/>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b<desc>c</desc>": "a x=2 bc",
        "a<xmp> <b>x</b>\n  &amp;</xmp>b": "a\n\n <b>x</b>\n  &amp;\n\nb",
        "".join(f"<input type={t} value={t}>" for t in ("search", "email", "url", "number", "tel", "date", "odd", "Submit")): "search email url number tel date odd Submit",
        "".join(f"<input type={t} value={t}>" for t in ("hidden", "checkbox", "radio", "password", "file", "range")) + "a": "a",
    }.items():
        assert html_text.html_text(page) == want, page


def test_html_tables_with_spans_and_bars():
    for page, want in {
        "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
        "<table><tr><td>a<td rowspan=2>bb<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>": "a | bb | c\nd |    | e\nf | g  | h",
        "<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d</table>": "ab  | c\n |  | d",
        "<table><tr><td>x<td>y |<tr><td>long<td></table>": "x    | y |\nlong",
        "<table><tr><td rowspan=0>a<td rowspan=99999999>b</table>c": "a | b\n\nc",
    }.items():
        assert html_text.html_text(page) == want, page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<style media=print>.a{display:none}</style><p class=a>shown", "shown"),
        ("<style media='screen, print'>.a{display:none}</style><p class=a>no<p>b", "b"),
        ("<noscript><style>.a{display:none}</style></noscript><p class=a>shown", "shown"),
        ("<template><style>.a{display:none}</style></template><p class=a>shown", "shown"),
        ("<p hidden style='display:block'>shown", "shown"),
        ("<style>p{display:block}</style><p hidden>shown", "shown"),
        ("<dialog>no</dialog><dialog style='display:block'>yes</dialog>", "yes"),
        ("<style>.b{content:\"}.a{display:none\"}</style><p class=a>shown", "shown"),
        ("<style>.b{content:'}' ; display:none} /* } .a{display:none} */</style><p class=a>shown<p class=b>no", "shown"),
        ("<p style='content:\"; display:none;\"'>shown", "shown"),
        ("<svg><text><![CDATA[hello <b>]]></text></svg>", "hello <b>"),
        ("<style>.x .y{display:none}</style><div class=x><p><i class=y>no</i>a</p></div><i class=y>b</i>", "a\n\nb"),
        ("<style>.x > .y{display:none}</style><div class=x><i class=y>no</i><p><i class=y>a</i></p></div>", "a"),
        ("<style>ul li > b{display:none}</style><ul><li><b>no</b>a</ul><b>b</b>", "- a\n\nb"),
        ("<style>@media screen{.a{display:none}} @media (max-width:9px){.b{display:none}} @media print{.c{display:none}}</style><p class=a>no<p class=b>b<p class=c>c", "b\n\nc"),
        ("<style>@layer x{.a{display:none}} @supports (display:grid){.b{display:none}}</style><p class=a>no<p class=b>b", "b"),
        ("<style>.a{color:red; .b{display:none}} .c{display:none}</style><p class=a>a<p class=b>b<p class=c>no", "a\n\nb"),
        ("<style>.a:hover{display:none} a + b{display:none} .c, .d:x{display:none}</style><p class=a>a<p class=c>no", "a"),
        ("<style>.a{display:none</style><p class=a>no<p>b", "b"),
        ("<span style=display:block>a</span><span style=display:block>b</span>", "a\nb"),
        ("<div style=display:inline>a</div><div style=display:inline>b</div>", "ab"),
        ("<p style=white-space:pre>a  b\n c", "a  b\n c"),
        ("<p style=white-space:pre-line>a  b\n c", "a b\nc"),
        ("<pre style=white-space:normal>a  b\n c</pre>", "a b c"),
        ("a<plaintext>b<p>c</plaintext>", "a\n\nb<p>c</plaintext>"),
    ],
)
def test_html_styles(page, want):
    assert html_text.html_text(page) == want


def test_wide_characters_are_aligned():
    page = "<table><tr><td>\u4e2d\u6587<td>a<tr><td>abcd<td>b<tr><td>e\u0301<td>c</table>"
    assert html_text.html_text(page).split("\n") == ["\u4e2d\u6587 | a", "abcd | b", "e\u0301    | c"]


def test_html_of_random_trees_with_sheets():
    """Words of random trees under rules with descendants and children, against a plain walk."""
    rng = random.Random(11)
    for _ in range(60):
        chosen = [(rng.choice("xyz"), rng.choice(["", " ", ">"]), rng.choice("xyz")) for _ in range(3)]
        sheet = " ".join(f".{b}{{display:none}}" if not j else f".{a}{j}.{b}{{display:none}}" for a, j, b in chosen)
        count = [0]

        def tree(above, chosen=chosen, count=count):
            own = rng.choice("xyzw")
            gone = any(own == b and (not j or (j == ">" and above and above[-1] == a) or (j == " " and a in above)) for a, j, b in chosen)
            count[0] += 1
            text, words = f"w{count[0]}", [f"w{count[0]}"]
            for _ in range(rng.randint(0, 3) if len(above) < 4 else 0):
                inner, more = tree([*above, own])
                text, words = f"{text} {inner}", words + more
            return f"<div class={own}>{text}</div>", [] if gone else words

        body, words = tree([])
        assert html_text.html_text(f"<style>{sheet}</style>{body}").split() == words, (sheet, body)


def test_html_visibility_and_style_sheets():
    for page, want in {
        "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z": "yes\nz",
        "<p style='visibility:collapse'>no<div>yes<i style='visibility:hidden'>no<hr><input value=no></i></div>": "yes",
        "<style>.h{display:none} #x , p.q { color:red; display : none }</style><p class='a h'>no<p class=q>no<div id=x>no</div><div class=q>yes</div>": "yes",
        "<p class=h>no</p>a<style>/* .a{} */ .h{display:none}</style>": "a",
        "<style>.h{display:none} p.h{display:block}</style><p class=h>yes<div class=h>no</div>": "yes",
        "<style>.h{display:none}</style><p class=h style='display:block'>yes<style>.k{display:none!important}</style><p class=k style=display:block>no": "yes",
        "<style>@media print{.h{display:none}} @import 'x'; .k{visibility:hidden}</style><p class=h>yes<p class=k>no": "yes",
        "<style>div ~ p{display:none} p:hover{display:none} {display:none}</style><div><p>yes</div>": "yes",
        "<style>div p{display:none}</style><div><p>no</div><p>yes": "yes",
        "<p style='display:none;display:block'>yes": "yes",
    }.items():
        assert html_text.html_text(page) == want, page
    for css in ("@a{" * 50_000, "a{" * 50_000, "/*" * 50_000, ".h{display:none" * 10_000, "}" * 50_000, "display:none;" * 20_000):
        html_text.html_text(f"<style>{css}</style><p style='{css}'>x")


def _random_page(rng, depth=0):
    """Markup of a random tree, and its visible words in order."""
    word = f"w{rng.randrange(10**6)}"
    kind = rng.choice(["text", "p", "div", "ul", "ol", "table", "hide", "invisible", "span", "pre", "quote", "select", "comment"])
    inside = [_random_page(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 4 else []
    marks, words = "".join(m for m, _ in inside), [w for _, ws in inside for w in ws]
    if kind in ("p", "div", "span", "pre"):
        return f"<{kind}>{word}</{kind}>{marks}", [word, *words]
    if kind == "quote":
        return f"<blockquote>{marks}</blockquote>{word} ", [*words, word]
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{m}" for m, _ in inside) + f"<li>{word}</{kind}>", [*words, word]
    if kind == "table":
        cells = [f"w{rng.randrange(10**6)}" for _ in range(6)]
        rows = "".join(f"<tr>{''.join(f'<td rowspan={rng.randint(1, 2)} colspan={rng.randint(1, 2)}>{c}' for c in cells[k : k + 2])}" for k in (0, 2, 4))
        return f"<table>{rows}</table>{marks}", [*cells, *words]
    if kind == "hide":
        how = rng.choice(["hidden", "style=display:none", "class=gone"])
        return f"<div {how}>{word}{marks}</div>", []
    if kind == "invisible":
        return f"<div style='visibility:hidden'>{word}<b style=visibility:visible>{word}x</b></div>{marks}", [word + "x", *words]
    if kind == "select":
        return f"<select><option>{word}<option>{word}y</select>{marks}", [word, word + "y", *words]
    if kind == "comment":
        return f"<!-- {word} --><script>{word}</script>{marks}", words
    return f" {word} {marks}", [word, *words]


def test_html_emits_all_visible_words_of_random_trees():
    rng = random.Random(0)
    for _ in range(400):
        parts = [_random_page(rng) for _ in range(4)]
        page = "<style>.gone{display:none}</style>" + "".join(m for m, _ in parts)
        assert re.findall(r"w\d+[xy]?", html_text.html_text(page)) == [w for _, ws in parts for w in ws], page


def test_html_of_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "x")], "page_id bigint, url string, html string, page_text string")
    assert html_text.extract(df).collect() == [(1, "a")] and html_text.extract(df.limit(0)).count() == 0


def test_html_survives_hostile_pages(spark):
    for page in ("<div>" * 50_000 + "x", "<table><tr><td>" * 2000 + "x", "<a b='" * 20_000, "</p>" * 2000, "<li>" * 5000, "<!--" * 5000, "<" * 5000):
        html_text.html_text(page)
    df = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", None), (2, "u", None)], "page_id bigint, url string, html string")
    assert sorted((r["page_id"], r["page_text"]) for r in html_text.extract(df).collect()) == [(1, "a"), (2, ""), (2, "")]


# --- token files --------------------------------------------------------------


def test_token_files_round_trip(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from motifmill.llm import common

    path = public.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    df, rows = corpus(spark, [(30, "a  b \n\n c <|endoftext|> d"), (31, "tab\there 's it's\nnew line")])
    scratch = common.Scratch(spark, "t")
    manifest, dictionary = token_files.write_token_files(df, path, scratch, shard_bytes=20_000)
    assert manifest.count() > 1
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, dictionary).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    shard = manifest.orderBy("shard").first()["path"]
    known = open(dictionary.removeprefix("file://"), "rb").read()
    with open(shard.removeprefix("file://"), "rb") as source:
        reader = token_files.ShardReader(source, known)
        assert np.frombuffer(reader.get(0), "<u4")[-1] == 2
        with pytest.raises(ValueError):
            token_files.ShardReader(source, known + b"x")
    none, name = token_files.write_token_files(df.limit(0), path, common.Scratch(spark, "t"))
    assert none.count() == 0 and token_files.read_token_files(none, name).count() == 0


def test_cached_encoder_equals_the_library():
    public = pytest.importorskip("public_tokenizers")
    encoder = token_files.CachedEncoder(public.path("byte_bpe_50k.json"), limit=20)
    rng = random.Random(1)
    parts = ["a", "B", " ", " ", "\n", "\t", ".", "'s", "é", "1", "<|endoftext|>", "😀", "\r", "中", "  ", "'", "\x1c", "_", "the", ","]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encoder(t) == encoder._library(t), repr(t)


def test_token_files_deal_one_id_to_many_tasks(spark):
    import public_tokenizers as public

    rows = [(7, "the same beginning of all these texts, which has more than 64 letters " + str(k % 5)) for k in range(3000)]
    rows += [(None, "no id")] * 2500 + [(k, f"text {k}") for k in range(-300, 300)] + [(2**62, "last")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    manifest, dictionary = token_files.write_token_files(df, public.path("byte_bpe_50k.json"), common.Scratch(spark, "t"), shard_bytes=10_000)
    back = token_files.read_token_files(manifest, dictionary).orderBy("start").collect()
    ids = [r["doc_id"] for r in back]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(back, back[1:]))
    most = manifest.groupBy("task").agg(F.sum("n_docs").alias("n")).agg(F.count(F.lit(1)).alias("tasks"), F.max("n").alias("most")).first()
    assert most["tasks"] > 10 and most["most"] < 1500
    encoder = token_files.CachedEncoder(public.path("byte_bpe_50k.json"))
    want = Counter((i, zlib.crc32(encoder(t) + np.array([2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in back) == want


def test_range_of_ids(spark):
    bounds = sorted([5] * 4 + list(range(10, 400, 2)) + [500])
    df = spark.createDataFrame([(k,) for k in [*range(0, 520), *[5] * 50]], "i bigint")
    got = df.select("i", token_files._range(F.col("i"), bounds).alias("r")).collect()
    assert {r["r"] for r in got if r["i"] == 5} == set(range(5))
    assert all(r["r"] == sum(b < r["i"] for b in bounds) for r in got if r["i"] != 5)


def test_packing_uses_several_sizes(spark):
    rng = random.Random(3)
    lengths = sorted((min(8192, int(rng.lognormvariate(6, 1.3)) + 1) for _ in range(4000)), reverse=True)
    _, sizes, _ = packing.pack(lengths, packing.CAPACITIES)
    cost = sum(packing.CAPACITIES[c] for c in sizes)
    assert sum(n >= 10 for n in Counter(sizes).values()) >= 3
    for single in packing.CAPACITIES:  # longer pieces go to the least size that holds them
        rest = {c: packing.CAPACITIES[c] for c in packing.CAPACITIES if c >= single}
        only = [min(c for c in rest if c >= n) for n in lengths if n > single]
        short = packing.best_fit([n for n in lengths if n <= single], {single: packing.CAPACITIES[single]}, single)[1]
        assert cost < sum(packing.CAPACITIES[c] for c in [*only, *short])


def test_packing_ignores_clashing_columns(spark):
    items = spark.createDataFrame([(k, 5 + k % 7) for k in range(40)], "doc_id bigint, n_tokens bigint")
    more = items.withColumns({c: F.lit("x") for c in ("i", "n", "p", "s", "shard", "rows", "pieces", "number", "run", "bin_id", "piece")})
    plain, out = packing.pack_lengths(items, {16: 20.0, 32: 34.0}), packing.pack_lengths(more, {16: 20.0, 32: 34.0})
    assert out.columns == plain.columns and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_token_counts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, n_tokens string")
    out = token_counts.token_counts(df, {token_counts.MARK: -1.0, "a": -2.0})
    assert out.columns == ["doc_id", "n_pretokens", "n_tokens"] and out.count() == 0


def test_quality_takes_one_text_of_an_id_that_repeats(spark):
    rows = [(i, t) for i, t, _ in _quality_rows()]
    labels = spark.createDataFrame([(i, y) for i, _, y in _quality_rows()], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    again = docs.unionByName(docs.select("doc_id", F.concat(F.lit("￿"), "text").alias("text"))).unionByName(docs).repartition(5)
    one, many = quality.fit(docs, labels), quality.fit(again, labels)
    assert np.array_equal(one.linear, many.linear) and np.array_equal(one.factors, many.factors)
    out = quality.score(again, many)
    assert out.count() == 3 * len(rows) and out.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 2").count() == 0
