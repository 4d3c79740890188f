"""Extra columns with clashing names, keys split into chunks, equal payloads, and joins beyond the size of a broadcast."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm import brute_groups, graded  # noqa: E402

from rasterloom.llm import common, components, embeddings, mixing, near_text, packing, quality, registry, simhash, toxicity, url_filters, warc  # noqa: E402

CLASHES = ["row", "rest", "key", "node", "fp", "root", "label", "size", "mix", "length", "__group", "__row", "__key", "__first", "__t", "__w", "__h", "__kept", "h", "k", "n", "v", "class", "host", "path", "prefix", "digest", "component_id", "payload", "refers_to", "group", "last", "id", "col"]


def widened(df, *but):
    for c in CLASHES:
        if c not in df.columns and c not in but:
            df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    text = "a text of some words that is long enough to be kept by all of the rules here"
    rows = [(1, text, "en", "s"), (2, text, "en", "s"), (3, None, None, None), (4, "", "en", "t"), (5, "other words here " * 3, "de", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_extra_columns_do_not_clash(spark, docs):
    wide = widened(docs)
    rows = lambda df: sorted(map(str, df.collect()))
    for f in (simhash.near_duplicates, mixing.mix_report, lambda df: packing.pack_documents(df, registry.byte_bpe()).drop("sequence_id", "offset"), lambda df: quality.judge(df, quality.DecisionList())):
        assert rows(f(wide)) == rows(f(docs))
    for f in (near_text.keep_one, mixing.mix, lambda df: quality.keep_good(df, quality.DecisionList()), lambda df: toxicity.keep_clean(df, toxicity.Model.empty())):
        assert f(wide).columns == wide.columns and sorted(str(r.doc_id) for r in f(wide).collect()) == sorted(str(r.doc_id) for r in f(docs).collect())
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "x"), (2, None, None), (3, "http://a.com/en/1", "x")], "page_id long, url string, html string")
    rules = url_filters.rule_table(spark, url_filters.RULES)
    assert rows(url_filters.judge(widened(pages), rules)) == rows(url_filters.judge(pages, rules))
    assert rows(warc.read(warc.write(warc.with_revisits(widened(pages)))).drop("archive")) == rows(warc.read(warc.write(warc.with_revisits(pages))).drop("archive"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, None, 0), (4, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    assert rows(embeddings.near_duplicates(widened(vectors))) == rows(embeddings.near_duplicates(vectors))


def test_joins_are_the_same_without_a_broadcast(spark, docs, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.com/en/{i % 4}", f"body {i % 5}") for i in range(60)] + [(99, None, None)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(i, [float(i % 6), 1.0, 0.5], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    rules = url_filters.rule_table(spark, url_filters.RULES)
    made = lambda: [rows(warc.with_revisits(pages)), rows(url_filters.judge(pages, rules)), rows(simhash.near_duplicates(docs)), rows(embeddings.near_duplicates(vectors)), rows(mixing.mix_report(docs))]
    few = made()
    for module in (warc, url_filters, simhash, embeddings, mixing, near_text, components):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, most_rows=0: df)
    assert made() == few


def test_first_of_equal_payloads_is_the_response(spark):
    bodies = ["", "same", "é", "x" * 9000]
    rows = [(i, "http://u/", bodies[int(k)]) for i, k in enumerate(np.random.default_rng(1).integers(0, 4, 300))] + [(300, "http://u/", None)]
    archives = common.cut(warc.write(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)), archive_bytes=5000))
    first: dict = {}
    for i, _, body in rows:
        first.setdefault(body or "", i)
    for r in warc.read(archives).collect():
        i = int(r.record_id.rsplit(":", 1)[1])
        body = (rows[i][2] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest(body))
        assert r.record_type == ("response" if first[body.decode()] == i else "revisit") and r.refers_to_id == (None if first[body.decode()] == i else f"urn:page:{first[body.decode()]}")


def test_heavy_anchors_in_chunks_join_what_one_key_joins(spark):
    texts = graded(np.random.default_rng(33), 40, 2)
    marked = common.cut(near_text.describe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    classes = marked.select("node", "anchors", "signature")
    whole, parts = ({(r.node, r.root) for r in components.connected(near_text.anchor_links(classes, key_rows=n)).collect()} for n in (16_384, 8))
    assert whole == parts and len(whole) > 60


@pytest.mark.parametrize("n", [17, 200])
def test_runs_of_alike_texts_against_brute_force(spark, n):
    texts = graded(np.random.default_rng(n), n, 1)
    kept = {r.doc_id for r in near_text.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == brute_groups(texts)


def test_components_by_contraction_and_in_one_task(spark):
    rng = np.random.default_rng(34)
    for n, m in ((50, 30), (400, 300), (3, 0)):
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-n, n, (m, 2))] + [(None, 1)], "a long, b long")
        near: dict = {}
        for a, b in edges.collect():
            if a is not None:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want, seen = set(), set()
        for start in sorted(near):
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want |= {(x, start)} if x != start else set()
                    todo += near[x]
        for few in (0, 10**6):
            assert {(r.node, r.root) for r in components.connected(edges, few_edges=few).collect()} == want
