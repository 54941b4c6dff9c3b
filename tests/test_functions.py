import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scores as S
from siltstone.functions import text as X
from siltstone.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("v")).first()[0]


@pytest.mark.parametrize("s,n,want", [(1, 1, 0.2065), (5, 5, 0.5655), (10, 10, 0.7225), (95, 100, 0.8882), (0, 1, 0.0), (9, 3, 0.4385), (1, 0, None)])
def test_wilson(spark, s, n, want):
    got = one(spark, S.wilson_lower(F.col("s"), F.col("n")), s=s, n=n)
    assert got is None if want is None else math.isclose(got, want, abs_tol=2e-4)


def test_decay_halves_in_thirty_days(spark):
    now = F.lit("2025-01-31").cast("timestamp")
    half = one(spark, S.search_decay(F.lit(1.0), F.lit("2025-01-01").cast("timestamp"), F.lit(0), now))
    never = one(spark, S.search_decay(F.lit(1.0), F.lit(None).cast("timestamp"), F.lit(0), now))
    assert math.isclose(half, 0.5, abs_tol=1e-3) and half == never


def test_sm2(spark):
    after = lambda q, e, r, i: one(spark, F.struct(S.sm2_easiness(F.lit(q), F.lit(e)), S.sm2_repetitions(F.lit(q), F.lit(r)), S.sm2_interval(F.lit(q), F.lit(e), F.lit(r), F.lit(i))))
    assert tuple(after(5, 2.5, 0, 0)) == (2.6, 1, 1)
    assert tuple(after(4, 2.5, 1, 1)) == (2.5, 2, 6)
    assert tuple(after(2, 2.5, 5, 30)) == (2.5, 0, 1)
    assert after(3, 1.3, 2, 6)[0] == 1.3


def test_ema_and_ctr(spark):
    assert math.isclose(one(spark, S.ema(F.lit(1.0), F.lit(0.0))), 0.3)
    assert one(spark, S.ctr_weight(F.lit(0.5), F.lit(0.5))) == 2.0 and one(spark, S.ctr_weight(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, S.minmax(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.cosine(a(1.0, 0.0), a(0.0, 1.0))) == 0.0
    assert math.isclose(one(spark, V.cosine(a(1.0, 1.0), a(2.0, 2.0))), 1.0)
    assert one(spark, V.cosine(a(1.0), a(1.0, 2.0))) == 0.0 and one(spark, V.cosine(a(0.0), a(0.0))) == 0.0
    assert one(spark, V.distance(a(0.0, 0.0), a(3.0, 4.0))) == 5.0
    assert one(spark, V.mean_vector(F.array(a(1.0, 2.0), a(3.0, 4.0)))) == [2.0, 3.0]
    two = F.array(a(1.0, 0.0), a(0.0, 1.0))
    assert math.isclose(one(spark, V.max_sim(two, two)), 2.0)
    assert one(spark, V.max_sim(two, F.expr("cast(array() as array<array<double>>)"))) == float("-inf")


@pytest.mark.parametrize("q,want", [("how does it work", "semantic"), ("what happened yesterday", "temporal"), ("why did it break", "causal"), ("what did we decide", "decision"), ("how to deploy", "procedural"), ("bugün ne oldu", "temporal"), ("neden bozuldu", "causal"), ("imago", "temporal"), ("", "semantic")])
def test_query_types(spark, q, want):
    assert one(spark, X.classify_query(F.lit(q))) == want


def test_domains(spark):
    assert one(spark, X.detect_domain(F.lit("fix the async function, cargo compile error in the struct impl"))) == "coding"
    assert one(spark, X.detect_domain(F.lit("nice weather"))) == "general"
    assert one(spark, X.detect_domain(F.lit("my budget, income, salary and mortgage payment"))) == "finance"


def test_words_and_keywords(spark):
    assert one(spark, X.extract_cues(F.lit("what happened with the cross-encoder deploy"))) == ["happened", "cross-encoder", "deploy"]
    assert one(spark, X.keywords_path(F.lit("src/search-engine/fusion_rank.rs"))) == "search engine fusion rank"
    assert one(spark, X.keywords_path(F.lit("src/lib.rs"))) is None
    assert one(spark, X.keywords_shell(F.lit("cargo test --release integration parser"))) == "test integration parser"
    assert one(spark, X.error_keywords(F.lit("build failed: missing symbol foo_bar in crate"))) == "build OR symbol OR foo_bar OR crate"
    assert one(spark, X.error_keywords(F.lit("all fine"))) is None


def test_trigrams(spark):
    assert math.isclose(one(spark, X.trigram_similarity(F.lit("word"), F.lit("two words"))), 0.3636, abs_tol=1e-4)
    assert one(spark, X.trigram_similarity(F.lit(""), F.lit(""))) == 0.0


def test_fingerprint_ignores_numbers(spark):
    f = lambda m: one(spark, X.fingerprint(F.lit("svc"), F.lit(m)))
    assert f("took 12 ms at node-3") == f("took 9000 ms at node-14") and len(f("x")) == 32 and f("a") != f("b")


def test_cuts_and_white_space(spark):
    assert one(spark, X.truncate_bytes(F.lit("aéé"), 4)) == "aé" and one(spark, X.truncate_bytes(F.lit("日本語"), 8)) == "日本" and one(spark, X.truncate_bytes(F.lit("🙂🙂"), 7)) == "🙂"
    assert one(spark, X.truncate_word(F.lit("one two three"), 9)) == "one two…"
    assert one(spark, X.cleanup_whitespace(F.lit("a\r\n \t b  c\n\n\n\nd"))) == "a\nb c\n\nd"
    assert one(spark, X.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, X.strip_fences(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'


@pytest.mark.parametrize("url,want", [("http://localhost/x", True), ("https://10.1.2.3:80/", True), ("http://172.20.0.1", True), ("http://172.32.0.1", False), ("http://192.168.1.1/a", True), ("http://169.254.0.9", True), ("http://db.internal", True), ("https://example.com", False), ("http://10.1.2.300", False)])
def test_private_urls(spark, url, want):
    assert one(spark, X.is_private_url(F.lit(url))) is want


def test_gate(spark):
    assert one(spark, X.passes_gate(F.lit("A title"), F.lit("x" * 50))) and not one(spark, X.passes_gate(F.lit("A title"), F.lit("short"))) and not one(spark, X.passes_gate(F.lit(None).cast("string"), F.lit("x" * 60)))
