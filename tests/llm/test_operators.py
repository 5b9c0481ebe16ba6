"""Every operator on small tables: brute force, round trips, held-out accuracy, and the edge cases that its docstring defines."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagforge.llm import html_extract, huffman, langid, matroska, mixing, neardup, packing, quality, queries, rules, toxicity

#: Nulls, empty texts, ties, repeated rows, a very long text, and extra columns that clash with result columns.
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t", None, "a"), (4, "one", "fr", "b"), (5, "one", "fr", "b"), (5, "one", "fr", "b"), (None, "null id words", "de", "b"),
    (7, "long word " * 30_000, "en", "c"), (8, "été <|endoftext|> \U0001f600 ***", "fr", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("x") for c in ("score", "size", "kept", "bin", "id", "media", "start", "n_words", "__x")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- 1 HTML


def test_html_by_template(sf):
    import html

    for page in pd.read_parquet(f"{sf}/pages.parquet").html:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split(r"<br>|</?(?:p|h1)>", article)
        want = "\n".join(b for b in (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in blocks) if b)
        assert html_extract.main_text(page) == want


LONG = "This is a paragraph of running text that is long enough to stand out from short lines."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<article><p>x &lt;b&gt; &amp;amp; y</p></article>", "x <b> &amp; y"),
        (f"<body><div class='menu'><a>x</a></div><h1>T</h1><p>{LONG}</p><p>Short.</p><div id='comments'><p>{LONG}</p></div><footer>{LONG}</footer></body>", f"T\n{LONG}\nShort."),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><form><p>Sign up</p></form><script>if (a < b) '</p>'</script><p>End.</p></main><div class='cookie-notice'>{LONG}</div>", f"{LONG}\nEnd."),
        (f"<ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><div><p>{LONG}</p></div><ul><li><a href=3>Next</a></li></ul>", LONG),
    ],
)
def test_html_cases(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{LONG}</p><p>{LONG} More.</p></div><ul><li><a href=1>Next</a></li><li><a href=2>Last</a></li><li><a href=3>Top</a></li></ul><article><p>Read this too.</p></article>", f"{LONG}\n{LONG} More."),
        (f"<article><p>Hi.</p><p>Yes.</p><p>No.</p><p>{LONG}</p><p>End.</p><p><a href=1>More of the same</a></p></article><p>Stay tuned.</p>", f"Hi.\nYes.\nNo.\n{LONG}\nEnd."),
        (f"<article><h2><a href=1>Title</a></h2><p>{LONG}</p><p><a>a</a></p><p><a>b</a></p><p><a>c</a></p><p>Share this</p></article>", f"Title\n{LONG}"),
        ("<article><p>Short.</p></article><p>Stay tuned.</p>", "Short."),
        (f"<article><p>{LONG}</p></article><p>{LONG}</p><p>{LONG} More.</p>", f"{LONG}\n{LONG}\n{LONG} More."),
    ],
)
def test_html_marks_only_bound_the_search(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("marked", [True, False])
def test_html_depends_on_window_and_surge(marked):
    body = f"<p>{LONG}</p>" + "<p><a href=1>Link</a></p>" * 3 + "<p>Ten chars.</p>" * 4 + f"<p>{LONG}</p>" + "<p><a href=1>Link</a></p>" * 9 + f"<p>{LONG[:50]}</p>"
    page = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    texts = {(w, s): html_extract.main_text(page, w, s).count("\n") + 1 for w, s in ((3, 60), (5, 60), (3, 40), (3, 100))}
    assert texts[3, 60] != texts[3, 40] and texts[5, 60] != texts[3, 60] if not marked else texts[3, 60] != texts[3, 40]


def test_html_words_in_doubt_only_lower_the_weight():
    page = f'<article><h1>Head</h1><p class="alert">{LONG}</p><div class="related-work"><p>{LONG} 2</p></div><p class="disclaimer">{LONG} 3</p></article>'
    assert html_extract.main_text(page) == f"Head\n{LONG}\n{LONG} 2\n{LONG} 3"
    assert html_extract.main_text(f'<div><p>{LONG}</p></div><p><a>x</a></p><p><a>y</a></p><p><a>z</a></p><p class="alert">{LONG[:80]}</p>') == LONG
    assert html_extract.main_text(f"<div><p>{LONG}</p><p>{LONG} 2</p></div><article><p>Buy now.</p></article>") == f"{LONG}\n{LONG} 2"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a href="x>foo</a> bar', "foo bar"), ("<p class=it's>a</p>b", "a\nb"), ("a < b <c", "a < b <c"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ('<p title="a > b">x</p>', "x"), ("x<!-- never closed", "x"), ("x<script>y", "x"),
        ("<p>a</p", "a</p"), ("x<![CDATA[y]]>z", "xz"),
    ],
)
def test_html_malformed(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("piece", ['<a href="x>', "<div>", "<p><b>", "<", "<a ", "<a b=\"x\" c='", "<script>", "<!--", "<li><i>", '<a =   "'])
def test_html_time_grows_with_the_page(piece):
    import time

    def seconds(n):
        page = piece * (n // len(piece))
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    assert seconds(800_000) < 8 * seconds(200_000) + 0.5


def test_html_table(spark):
    rows = [(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (2, None, None), (None, "v", "<p>é\U0001f600</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "é\U0001f600", 2), (1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_extract.extract(pages.where("false")).count() == 0


# -- 2, 3, 4 classifiers


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (len(y) - y.sum())


@pytest.mark.parametrize(("name", "target", "least"), [("op2_toxicity", "toxic", 0.9), ("op3_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, target, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.5 if target == "toxic" else 0.3))).all()
    m = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert auc(m.score.to_numpy(), m[target].to_numpy()) > least


@pytest.mark.parametrize("module", [toxicity, quality, rules])
def test_classifiers_on_odd_tables(spark, odd, none, module):
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (7, 1, 1), (None, 1, 1), (8, 0, None)], "doc_id bigint, quality int, toxic int")
    apply = rules.apply if module is rules else module.classify
    for table in (labels, labels.where("false")):
        model = module.train(odd, table)
        got = apply(odd, model).collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 5, 5, 7, 8]
        fives = [r.asDict() for r in got if r.doc_id == 5]
        assert fives[0] == fives[1]
        assert apply(none, model).count() == 0


def brute_rules(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_rules_by_brute_force(docs):
    texts = [None, "", "a b c a b c", "a a a a", "x\nx\n\n \n \nx ", "   b #*$%&|<>", *[t for t in docs.text if len(t) < 3000][:60]]
    for t in texts:
        assert rules.base_figures(t) == brute_rules(t)


def test_base_figures_equal_sql(spark, sf):
    import duckdb

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = queries.op4_quality_rules(spark, sf).select(*names).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
      coalesce(covered.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) ORDER BY doc_id""").df()
    pd.testing.assert_frame_equal(got, want[names], check_dtype=False)


def test_rules_classifier_on_other_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = rules.train(docs, labels.where("doc_id % 2 = 0"))
    got = rules.apply(docs, model).toPandas().merge(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "y").toPandas(), on="doc_id")
    got = got[~got.base_failed]
    assert auc(got.quality.to_numpy(), got.y.to_numpy()) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality, rules])
def test_training_sample_counts_a_row_once(spark, module):
    from tagforge.llm.common import labelled_sample

    rows = [(i, f"text {i} " * 5) for i in range(300)] + [(1, "hot id")] * 10_000 + [(2, f"hot id {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)] * 3, "doc_id bigint, quality int, toxic int")
    target = "toxic" if module is toxicity else "quality"
    sample = labelled_sample(docs, labels, target, F.lit(True), 200)
    got = sample.toPandas()
    assert len(got) <= 200 and got.groupby("y").size().max() <= 100 and not got.duplicated(["y", "text"]).any()
    small = labelled_sample(docs, labels, target, F.lit(True), 200, size=1000).toPandas()
    assert small.text.str.len().sum() <= 1200 and set(small.y) == {0, 1}


def test_rules_query(spark, sf, docs):
    got = queries.op4_quality_rules(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all() and not (got.kept & failed).any()
    assert (got.kept == (~failed & (got.quality >= rules.THRESHOLD))).all()
    assert set(rules.accepted(spark.read.parquet(f"{sf}/documents.parquet"), {"weight": np.zeros(1 << rules.BITS, np.float32), "bias": np.array(9.0)}).toPandas().doc_id) == set(got.index[~failed])


# -- 5 Matroska


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
def test_matroska_round_trip(lacing):
    for n in (0, 1, 575, 576, 577, 50_000):
        payload, size = matroska.to_payload("x" * n)
        assert size == n and len(payload) % 576 == 0 and len(payload) > 0
        assert matroska.features(matroska.write_media(payload, lacing=lacing))[0] == payload


@pytest.mark.parametrize("lacing", ["xiph", "ebml"])
def test_uneven_laces(lacing):
    frames = [bytes(n) for n in (0, 254, 255, 256, 511, 3, 70_000, 1)]
    body = matroska.block_body(frames, -5, lacing)
    out = matroska.Media(frame_ms={1: 2.0}, clusters=1)
    matroska._block(body, 0, len(body), 100, None, out)
    assert out.size == [len(f) for f in frames] and out.timestamp[:3] == [95, 97, 99]


def test_unknown_sizes_groups_and_cues():
    m = matroska
    block = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block_body([b"abc"], 1, "none")) + m.number(m.REFERENCE_BLOCK, 1))
    unknown = b"\x01" + b"\xff" * 7
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.TIMESTAMP, 10) + block
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + cluster + cluster + m.element(m.CUES, m.element(m.CUE_POINT, m.number(m.CUE_TIME, 7) + m.element(m.CUE_TRACK_POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_CLUSTER_POSITION, 0))))
    t = m.packets(data)
    assert (t.timestamp, t.key, t.cluster, t.size, t.clusters, t.cues) == ([11, 11], [False, False], [0, 1], [3, 3], 2, [(7, 1, data.index(cluster))])
    assert [data[a : a + 3] for a in t.start] == [b"abc", b"abc"]
    for bad in (b"", b"RIFF", data[:40]):
        assert m._table(bad).track == []
    with pytest.raises(ValueError, match="EBML"):
        m.packets(b"\x42\x86\x81\x01")


def test_cues_point_at_clusters():
    data = matroska.write_media(bytes(576 * 200))
    t = matroska.packets(data)
    assert len(t.cues) == t.clusters == 4
    assert all(data[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, at in t.cues)
    assert [time for time, _, _ in t.cues] == [t.timestamp[t.cluster.index(k)] for k in range(4)]


def test_timestamp_scale():
    m = matroska
    block = m.element(m.SIMPLE_BLOCK, m.block_body([b"abc"], 1, "none"))
    for scale in (1_000_000, 2_000_000, 500_000):
        body = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, scale)) + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 99) + block)
        assert m.packets(m.element(m.EBML, b"") + m.element(m.SEGMENT, body)).timestamp == [scale // 10_000]


def test_media_query_by_hashlib(spark, sf, docs):
    import hashlib

    got = queries.op5_media_columns(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = matroska.write_media(payload)
        row = got.loc[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (row.media_bytes, row.media_sha256, row.n_packets) == (len(media), hashlib.sha256(media).hexdigest(), len(payload) // 576)


def test_media_figures_equal_sql(spark, sf):
    import duckdb

    got = queries.op5_media_columns(spark, sf).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute("""SELECT doc_id, n AS n_bytes, padded AS payload_bytes, sha256(encode(coalesce(text, '')) || unhex(repeat('FF', (padded - n)::INT))) AS payload_sha256 FROM (
      SELECT *, strlen(coalesce(text, ''))::BIGINT AS n, greatest(1, (strlen(coalesce(text, '')) + 575) // 576)::BIGINT * 576 AS padded FROM documents) ORDER BY doc_id""").df()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_matroska_tables(spark, odd, none):
    stored = matroska.store_texts(odd)
    table = matroska.packet_table(stored).toPandas()
    got = matroska.digest(odd).toPandas()
    assert table.byte_size.sum() == got.payload_bytes.sum() and got[got.doc_id == 1].payload_bytes.tolist() == [576]
    same = got[got.doc_id.isin([4, 5])].drop(columns="doc_id").drop_duplicates()
    assert len(same) == 1
    assert matroska.digest(none).count() == 0 and matroska.packet_table(stored.where("false")).count() == 0


# -- 6 near-duplicates


def brute_components(table, width, percent):
    sets = {}
    for i, t in table:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def families():
    """A base with copies at all distances, a chain whose ends don't link, truncations, and unrelated texts."""
    random = np.random.default_rng(5)
    vocab = np.array([f"w{i}" for i in range(3000)])
    base = vocab[random.integers(0, 3000, 160)]
    out = [base]
    for n in range(60):
        t = base.copy()
        t[random.choice(160, n % 12, replace=False)] = vocab[random.integers(0, 3000, n % 12)]
        out.append(t)
    last = base
    for _ in range(8):
        last = last.copy()
        last[random.choice(160, 3, replace=False)] = vocab[random.integers(0, 3000, 3)]
        out.append(last)
    out += [base[:n] for n in range(100, 160, 4)] + [base[n:] for n in range(4, 60, 7)]
    out += [vocab[random.integers(0, 3000, 120)] for _ in range(20)]
    order = random.permutation(len(out))
    return [(int(i), " ".join(out[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, width, percent):
    table = families() + [(900, "a b"), (901, "A  b"), (902, "a"), (903, ""), (904, None)]
    want, sizes = brute_components(table, width, percent)
    got = neardup.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string"), width, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_query(spark, sf, docs):
    want, _ = brute_components(list(zip(docs.doc_id, docs.text, strict=True)), 3, 85)
    got = queries.op6_minhash_near_dedup(spark, sf).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want


def test_near_duplicates_on_odd_tables(spark, odd, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect()), key=repr)
    assert got == sorted([(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (7, 2, 7, True), (8, 2, 8, True)], key=repr)
    assert neardup.near_duplicates(none, 3, 85).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.survivors(odd, 3, 85).collect()) == [0, 1, 2, 3, 4, 7, 8]


def test_near_duplicates_with_null_and_shared_ids(spark):
    base, other, third = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, base), (None, other), (None, "null words"), (None, None), (5, other), (5, third), (5, third), (5, None), (6, third + " end"), (7, base), (8, base + " end"), (9, other), (9, other + " end"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.near_duplicates(docs, 3, 85).collect()
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(
        [(5, 58, 5, True), (5, 58, 5, True), (5, 58, 5, True), (5, 0, 5, True), (6, 59, 5, False), (7, 58, 7, True), (8, 59, 7, False), (9, 58, 5, False), (9, 59, 5, False), (9, 0, 9, True)]
    )
    kept = sorted(((r.doc_id, r.text) for r in neardup.survivors(docs, 3, 85).collect()), key=repr)
    assert kept == sorted([(None, base), (None, other), (None, "null words"), (None, None), (5, other), (5, third), (5, None), (7, base), (9, "")], key=repr)


@pytest.mark.parametrize("n", [20, 63, 64, 65, 300])
def test_no_pair_is_lost_on_either_side_of_the_sketch_size(spark, n):
    """Pairs just at the threshold, of sets below and above SKETCH_SHINGLES, all in one table."""
    random = np.random.default_rng(n)
    table, want = [], set()
    for k in range(40):
        words_ = [f"k{k}w{i}" for i in range(n + 2)]
        other = words_.copy()
        for at in sorted(random.choice(n + 2, max(0, int(0.08 * n / 3)), replace=False)):
            other[at] = f"x{k}_{at}"
        table += [(2 * k, " ".join(words_)), (2 * k + 1, " ".join(other))]
    want, _ = brute_components(table, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_hubs_and_many_rounds(spark, monkeypatch):
    """Hubs, repeated texts of centres and further rounds in buckets, forced on a small table."""
    monkeypatch.setattr(neardup, "PAIRS", 5)
    monkeypatch.setattr(neardup, "HUBS", 4)
    table = families()
    want, _ = brute_components(table, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_densified_bins_estimate_similarity():
    random = np.random.default_rng(1)
    for n in (5, 40, 400):
        a = np.unique(random.integers(0, 2**63, 2 * n).astype(np.uint64))
        x, y = a[: int(1.5 * n)], a[int(0.5 * n) :]
        agree = []
        for k in range(30):
            turned = [np.sort(neardup._mix(v + np.uint64(k))) for v in (x, y)]
            a_bins, b_bins = neardup.signatures(turned)
            agree.append((a_bins == b_bins).mean())
        assert np.mean(agree) == pytest.approx(0.5, abs=0.1)


# -- 7 Huffman


def test_code_lengths_are_optimal_and_limited():
    random = np.random.default_rng(2)
    counts = np.zeros(500, np.int64)
    counts[::3] = random.geometric(0.01, 167)
    lengths = huffman.code_lengths(counts)
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1.0 and (lengths[counts == 0] == 0).all()
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((lengths * counts).sum()) == cost
    steep = 2 ** np.arange(40, dtype=np.int64)
    assert huffman.code_lengths(steep, 16).max() == 16
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_block_round_trip():
    random = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 10_000):
        ids = np.minimum(random.geometric(0.02, n), 299)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=300) + 1)
        codes = huffman.canonical(lengths)
        block = huffman.encode_block(ids, lengths, codes)
        assert (huffman.decode_block(block, huffman.decode_table(lengths, codes)) == ids).all()


def test_token_query_equals_library(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.op7_token_huffman(spark, sf).toPandas().set_index("doc_id")
    start = 0
    for i, t in docs.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_tokens_on_odd_tables(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = huffman.round_trip(odd, queries.tokenizer_path()).toPandas().sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    want = Counter(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in ODD)
    assert Counter(got.n_tokens) == want
    assert huffman.round_trip(none, queries.tokenizer_path()).count() == 0


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Two  spaces and\nlines", "ÉTÉ it's", "", None, "a\tb"]
    assert [np.frombuffer(x, "<u2").tolist() for x in huffman.encode(path, texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_cache_equals_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["It's I'M we'll x's", "naïve ÉTÉ straße İstanbul ΣΣ", "a b c\x1cd\x85e", "é café, 12,345.67 #*&%$|", "<|endoftext|> x<|startoftext|>", "ªºµ ×÷", "\U0001f600!!! ???", ""]
    for t in texts:
        assert np.frombuffer(huffman.encode(path, [t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


# -- 8 packing


def check_bins(table, sizes, lengths):
    table = table.sort_values(["doc_id", "piece"])
    for i, n in sizes:
        p = table[table.doc_id == i]
        assert p.piece_words.sum() == n
    full = table[table.bin.notna()]
    for _, b in full.groupby(["shard", "bin"]):
        b = b.sort_values("bin_offset")
        used = b.piece_words.sum()
        assert (b.bin_offset.to_numpy() == np.cumsum(b.piece_words) - b.piece_words).all()
        assert b.bin_length.nunique() == 1 and b.bin_length.iloc[0] == min(x for x in lengths if x >= used)


def brute_best_fit(sizes, lengths, opening):
    bins = []
    for s in sizes:
        fit = [b for b in bins if b[1] - b[0] >= s]
        if fit:
            b = min(fit, key=lambda b: b[1] - b[0])
        else:
            bins.append(b := [0, opening[min(y for y in lengths if y >= s)]])
        b[0] += s
    return sum(packing.cost(min(x for x in lengths if x >= b[0])) for b in bins)


def placed_cost(sizes, lengths, opening=None):
    bins, _, final = packing.best_fit(sizes, lengths, opening)
    return sum(packing.cost(int(final[bins == b][0])) for b in set(bins.tolist()))


@pytest.mark.parametrize("draw", ["all", "peaked", "small"])
def test_joint_opening_by_brute_force(draw):
    import itertools

    random = np.random.default_rng(4)
    for lengths in ((16, 32, 64), packing.LENGTHS):
        top = max(lengths)
        sizes = {"all": random.integers(1, top + 1, 400), "peaked": random.integers(int(top * 0.07), int(top * 0.08) + 1, 400), "small": random.integers(1, top // 10, 400)}[draw]
        sizes = np.sort(np.maximum(sizes, 1))[::-1]
        tables = [dict(zip(lengths, o, strict=True)) for o in itertools.product(*[[k for k in lengths if k >= n] for n in lengths])]
        costs = [brute_best_fit(sizes.tolist(), lengths, t) for t in tables]
        got = placed_cost(sizes, lengths)
        assert got == pytest.approx(min(costs))
        unit = placed_cost(sizes, lengths, packing.unit_table(lengths))
        assert got <= unit + 1e-6 and (draw != "peaked" or lengths != packing.LENGTHS or got < 0.97 * unit)


def test_repeated_rows_are_dealt_over_shards(spark):
    rows = [(1, "a b c")] * 20_000 + [(i, "x " * i) for i in range(2, 50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_rows=1000).toPandas()
    assert len(got) == 20_048 and (got.doc_id == 1).sum() == 20_000 and got.groupby("shard").size().max() < 1500


def test_packing_query(spark, sf, docs):
    got = queries.op8_best_fit_packing(spark, sf).toPandas()
    check_bins(got, [(i, len(words(t))) for i, t in zip(docs.doc_id, docs.text, strict=True)], packing.LENGTHS)
    used = got.drop_duplicates(["shard", "bin"]).bin_length.sum()
    assert got.piece_words.sum() / used > 0.9


def test_packing_on_odd_tables(spark, odd, none):
    got = packing.pack(odd.where("doc_id is not null"), shard_rows=3).toPandas()
    check_bins(got[got.doc_id != 5], [(i, len(words(t))) for i, t, _, _ in ODD if i not in (None, 5)], packing.LENGTHS)
    assert (got.doc_id == 5).sum() == 2 and (got.doc_id == 7).sum() == -(-60_000 // 4096)
    assert packing.pack(odd).where("doc_id is null").count() == 1
    assert packing.pack(none).count() == 0


# -- 9 language


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.op9_language_id(spark, sf).toPandas().merge(d, on="doc_id")
    assert len(got) == len(d) and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_kernel_by_brute_force(docs):
    texts = ["abc abd", "xyz abc", "éa", "", *sorted(docs.text.dropna(), key=len)[-6:], *docs.text.dropna()[:20]]
    low = [t.translate({c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}) for t in texts]
    grams = [{t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)} for t in low]
    want = np.array([[len(a & b) / np.sqrt(max(len(a) * len(b), 1)) for b in grams] for a in grams])
    assert np.allclose(langid.kernel(texts, texts), want, atol=0.01)


def test_scores_equal_the_kernel_form(docs):
    rows = [{"y": y, "text": t} for y, t in zip(docs.lang, docs.text, strict=True) if y and t]
    model = langid.fit(rows[:120], landmarks=24)
    names = model["names"].tolist()
    marks = [r["text"] for n in names for r in [r for r in rows[:120] if r["y"] == n][: max(1, 24 // len(names))]]
    texts = [r["text"] for r in rows[120:]]
    values, vectors = np.linalg.eigh(langid.kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.hstack([langid.kernel([r["text"] for r in rows[:120]], marks) @ root, np.ones((120, 1))])
    y = np.array([r["y"] for r in rows[:120]])
    w = np.array([120 / len(names) / (y == v).sum() for v in y])[:, None]
    coef = np.linalg.solve((x * w).T @ x + 1e-2 * np.eye(x.shape[1]), (x * w).T @ np.where(y[:, None] == np.array(names), 1.0, -1.0))
    want = np.hstack([langid.kernel(texts, marks) @ root, np.ones((len(texts), 1))]) @ coef
    assert np.allclose(langid.outputs(model, texts), want, atol=1e-3)


def test_language_sample_counts_a_row_once(spark):
    rows = [(i, f"text {i}", "en") for i in range(50)] + [(1, "text 1", "en")] * 5000
    kept = []
    import tagforge.llm.langid as module

    fit, module.fit_on_executor = module.fit_on_executor, lambda sample, _: kept.append(sample.count())
    try:
        module.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_rows=40)
    finally:
        module.fit_on_executor = fit
    assert kept[0] <= 40


def test_language_on_odd_tables(spark, odd, none):
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.train(odd)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "fr", "de")
    blank = langid.identify(odd, langid.train(none)).collect()
    assert {r.lang_pred for r in blank} == {"und"} and langid.identify(none, langid.train(none)).count() == 0


# -- 10 mixing


def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 400}
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, goal, total = set(order), {}, float(sum(sizes.values()))
    while True:
        level = (total - sum(goal.values())) / sum(weight[k] for k in left)
        over = [k for k in left if level * weight[k] > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            goal[k] = 3.0 * sizes[k]
            left.discard(k)
    goal |= {k: level * weight[k] for k in left}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goal)


def test_mix_equals_sql(spark, sf):
    import duckdb

    got = queries.op10_source_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_draws_differ_for_null_and_repeated_ids(spark):
    rows = [(None, f"null id {i}", "a") for i in range(300)] + [(7, f"same id {i}", "a") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert df.select(mixing.uniform("doc_id", "text")).distinct().count() == 600


def test_weight_from_a_column(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b", None if i % 2 else 5.0) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, quality double")
    p = mixing.plan(d, weight="quality").toPandas()
    part = p[p.doc_id >= 1000]
    extra = part.taken - part.taken.min()
    assert (extra[part.doc_id % 2 == 0] > 0).mean() > (extra[part.doc_id % 2 == 1] > 0).mean()
    assert mixing.mixed(d, weight="quality").columns == d.columns


def test_mix_on_odd_tables(spark, odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[7] == 60_000
    again = mixing.plan(odd.repartition(3)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_heavier_documents_are_drawn_first(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    p = mixing.plan(d, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).toPandas().merge(d.select("doc_id", "source").toPandas(), on="doc_id")
    part = p[p.source == "a"]
    extra = part.taken - part.taken.min()
    assert abs(p.taken.sum() - 15_000) <= 20 and (extra[part.doc_id % 2 == 0] > 0).mean() > 1.3 * (extra[part.doc_id % 2 == 1] > 0).mean()


GOOD = "plain running words that make a sentence of usual length\nand another line of it"
WORSE = {
    "symbols": GOOD.replace(" w", " #|w").replace(" o", " *$o"), "digits": GOOD.replace("words", "1234567890 2024 77").replace("line", "0042"), "letters": " ".join("ab c d e f g h i".split() * 4),
    "glued": GOOD.replace(" ", ""), "lines": "\n".join(["the same line again and again"] * 6),
}


def test_default_weight_orders_the_draw(spark):
    rows = [(i, GOOD, "a") for i in range(400)] + [(1000 * k + i, t, "a") for k, t in enumerate(WORSE.values(), 1) for i in range(400)] + [(10_000 + i, "other source of words", "b") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weight = {r.doc_id: r.w for r in d.select("doc_id", mixing.quality_weight("text").alias("w")).where("doc_id % 1000 = 0").collect()}
    assert weight[0] == 1.0 and all(weight[1000 * k] < 0.9 for k in range(1, len(WORSE) + 1))
    p = mixing.plan(d, weights=(1, 4)).toPandas().set_index("doc_id").taken
    drawn = lambda k: (p[[1000 * k + i for i in range(400)]] > 0).mean()
    assert 0.1 < drawn(0) < 0.95 and all(drawn(0) > drawn(k) for k in range(1, len(WORSE) + 1))


def test_running_totals_in_groups(spark, monkeypatch):
    rows = [(i, f"{'w ' * (1 + i % 7)}{i}", "ab"[i % 3 == 0]) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.plan(d).collect()))
    monkeypatch.setattr(mixing, "GROUPED", 3)
    assert sorted(map(tuple, mixing.plan(d).collect())) == want


def test_survivors_beside_any_column(spark):
    rows = [(i % 6, f"words of text number {i} and some more of them", "x") for i in range(12)] + [(100, "words of text number 3 and some more of them", "x"), (None, "a", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, v string")
    want = sorted((r.doc_id or -1, r.text) for r in neardup.survivors(d).collect())
    for names in (("__kept", "__set"), ("__KEPT", "__key_"), ("id", "rows"), ("any", "set_key"), ("__key", "__text__")):
        got = neardup.survivors(d.withColumns({n: F.lit("x") for n in names}))
        assert set(names) <= set(got.columns) and sorted((r.doc_id or -1, r.text) for r in got.collect()) == want


def test_sketches_change_nothing(spark):
    docs = spark.createDataFrame(families(), "doc_id bigint, text string")
    rows = lambda **k: sorted(map(tuple, neardup.near_duplicates(docs, 3, 85, **k).collect()))
    assert rows() == rows(sketch=False)


@pytest.mark.parametrize("make", [toxicity, quality, rules])
def test_size_bounds_the_sample(spark, sf, make):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    whole, least = make.train(docs, labels), make.train(docs, labels, size=2)
    assert any(not np.array_equal(whole[k], least[k]) for k in whole)


# -- scores recomputed from dictionaries of n-grams


def hashed(points, order, bits):
    """The n-gram hash of features.char_ngrams, one number at a time."""
    h, m = 0, 0xFFFFFFFF
    for p in points:
        h = (h * 0x01000193 + p + 1) & m
    h = ((h ^ h >> 15) * 0x9E3779B1 + order * 0x632BE5AB) & m
    return ((h ^ h >> 13) * 0x9E3779B1 & m) >> 32 - bits


def test_toxicity_scores_by_dictionaries(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(20), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    for r in toxicity.classify(docs, model).join(docs, "doc_id").collect():
        points = [p + 32 if 65 <= p <= 90 or 0xC0 <= p <= 0xDE and p != 0xD7 else p for p in map(ord, r.text)]
        grams = Counter(hashed(points[i : i + n], n, toxicity.BITS) for n in toxicity.ORDERS for i in range(len(points) - n + 1))
        z = float(model["bias"]) + sum(float(model["weight"][g]) * (c / len(points)) ** 0.5 for g, c in grams.items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
