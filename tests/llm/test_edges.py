"""Every operator on edge cases and on empty tables, and every pipeline stage."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from comparing import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import (
    language_id, mixing, near_dedup, piece_codec, quality_rules, sharding, substring_dedup, token_counts, url_filter, vector_dedup,
)
from brindle.llm.queries import URL_RULES, queries, vocabulary

OPERATORS = {
    "near": lambda d: near_dedup.near_duplicates(d, percent=85),
    "drop_near": near_dedup.drop_near_duplicates,
    "count": lambda d: token_counts.count(d, vocabulary()),
    "language": lambda d: language_id.predict(d, language_id.train(d)),
    "encode": lambda d: piece_codec.digests(piece_codec.encode(d, vocabulary())),
    "shard": lambda d: sharding.shard(d, shards=3),
    "mix": mixing.mix,
    "repeat": lambda d: mixing.repeat(mixing.mix(d)),
    "judge": lambda d: quality_rules.judge(quality_rules.measure(d)),
    "filter": quality_rules.filter_quality,
    "substring": substring_dedup.remove_repeats,
}
ONE_EACH = ["near", "count", "language", "encode", "shard", "mix", "judge", "substring"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edge, name):
    assert OPERATORS[name](edge.limit(0)).count() == 0


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_each(edge, name):
    assert OPERATORS[name](edge).count() == edge.count()


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_confirms_each_text_of_a_key():
    """Two texts of one key and of equal length, one after the other."""
    one, two = "a b c d e f g", "t u v w x y z"
    pairs = pa.RecordBatch.from_pydict({"a": [1, 1], "b": [2, 2], "text_a": [one, two], "text_b": [two, two]})
    assert [b.num_rows for b in near_dedup._confirm(85, 5)(iter([pairs]))] == [1]


def test_near_edges(edge):
    r = _by_id(OPERATORS["near"](edge))
    assert (r[1].n_shingles, r[1].component_id, r[1].kept) == (0, 1, True)
    assert (r[2].component_id, r[3].component_id, r[4].n_shingles) == (2, 3, 1)
    assert (r[5].component_id, r[5].kept, r[11].component_id, r[11].kept) == (5, True, 10, False)
    assert (r[None].component_id, r[None].kept) == (None, True)
    kept = sorted(str(x.doc_id) for x in OPERATORS["drop_near"](edge).collect())
    assert kept == sorted(map(str, [1, 2, 3, 4, 5, 5, None, 7, 8, 9, 10]))


def test_language_edges(edge):
    r = _by_id(OPERATORS["language"](edge))
    assert all((r[i].lang_pred, r[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert r[4].lang_pred in ("de", "en", "es", "fr")
    none = language_id.predict(edge, language_id.train(edge.withColumn("lang", F.lit(None).cast("string"))))
    assert {(x.lang_pred, x.score) for x in none.collect()} == {("und", 0.0)}


def test_more_languages_than_a_group(spark):
    rows = [(i, f"l{i:02}", f"word{i} " * 20 + "und so weiter") for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    r = _by_id(language_id.predict(table, language_id.train(table)))
    assert all(r[i].lang_pred == f"l{i:02}" and 0.5 < r[i].score <= 1 for i in range(70))


def test_encode_edges(edge):
    r = _by_id(OPERATORS["encode"](edge))
    assert all((r[i].n_tokens, r[i].ids_sha256) == (1, hashlib.sha256(b"2").hexdigest()) for i in (1, 2))


def test_shard_edges(edge):
    rows = OPERATORS["shard"](edge).collect()
    assert {(x.doc_id, x.size, x.text_crc32) for x in rows} >= {(1, 8, 0), (4, 11, zlib.crc32(b"one"))}
    for shard in {x.shard for x in rows}:
        slots = sorted(x.slot for x in rows if x.shard == shard)
        assert slots == list(range(len(slots)))


def test_mix_edges(edge):
    rows = OPERATORS["mix"](edge).collect()
    assert {x.source for x in rows} == {"a", "b", "c", "d", None}
    assert all(0 <= x.copies <= 3 for x in rows)
    sizes = {x.source: x.source_size for x in rows}
    assert sum({x.source: x.target for x in rows}.values()) == pytest.approx(sum(sizes.values()))


def test_substring_edges(edge):
    r = _by_id(OPERATORS["substring"](edge))
    assert (r[1].n_words, r[3].n_words, r[7].n_removed, r[5].n_removed) == (0, 0, 0, 0)
    assert (r[10].n_removed, r[11].n_removed, r[11].text) == (0, 30, "")


def test_quality_edges(edge):
    r = _by_id(OPERATORS["judge"](edge))
    assert r[1].base_failed and not r[1].kept and r[1].word_chars == 0
    assert r[7].n_repeat_words == r[7].n_words == 40_000


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 0),
        (7, [None, 1.0], 0), (8, [float("nan"), 1.0], 0), (9, [1.0, 0.0], None), (10, [], 0), (11, [1.0, 0.0, 0.0], 0),
        (None, [1.0, 0.0], 0), (12, [1e200, 1e199], 0), (13, [-0.0, 1.0], 0), (14, [0.0, 1.0], 0), (14, [0.0, 1.0], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    r = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vector_dedup.near_duplicates(table).collect()}
    assert r[1] == (3, 1, True) and r[2] == (3, 1, False) and r[3] == (3, 1, False) and r[12] == (3, 1, False)
    assert r[13] == (2, 13, True) and r[14] == (2, 13, False)
    assert all(r[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and r[None] == (0, None, True)
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_vectors_over_many_partitions(spark):
    """Pairs are found however few rows a task has."""
    rng = np.random.default_rng(6)
    first = rng.standard_normal((600, 64)) + 3
    both = np.concatenate([first, first + 0.3 * rng.standard_normal((600, 64))])
    unit = both / np.linalg.norm(both, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 600
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(table).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(want.tolist()))


def test_urls(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "https://a.example.com/en/1"), (6, "http://b.net/es/"),
        (7, "http://net/fr/1"), (8, "http://x.com"), (9, "http://example.com/EN/"), (9, "http://example.com/EN/"), (10, "a://b://c/d"),
        (11, "http://notexample.com/en/" + "p" * 5000), (12, "http://É.org/ü?q"), (13, "https://free-bets.other.org/en/2"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("path", F.lit("clash"))
    model = url_filter.train(url_filter.default_labels(spark))
    r = {x.page_id: x for x in url_filter.judge(pages, URL_RULES, model).collect()}
    assert [(r[i].host, r[i].path, r[i].rule) for i in (1, 2, 3)] == [("", "", None)] * 3
    assert (r[4].host, r[4].path, r[4].rule, r[4].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [(r[i].rule, r[i].verdict) for i in (5, 6, 7)] == [("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block")]
    assert (r[8].rule, r[9].rule, r[11].rule) == (None, "com/", "com/")
    assert (r[10].host, r[10].path) == ("b:", "//c/d") and r[12].host == "É.org"
    assert r[13].verdict == "block"
    assert url_filter.judge(pages.limit(0), URL_RULES, model).count() == 0


# Sites whose host is in no labelled URL as such. Labels with like words were added after these had been chosen, so they
# show what was learned and are no held-out set: on hosts chosen by others recall is far lower (README).
LIKE_LABELS = {
    "block": ("pokerstars-bonus", "vegas-casino-club", "live-betting-odds", "adultfriend-dating", "camgirls-xxx", "pornhd-tube", "adserver-click", "tracking-pixel-ads",
              "link-spam-farm", "viagra-pills-shop", "keygen-cracks", "instant-payday-loan", "wetten-bonus", "casino-bonus-gratuit", "apuestas-casino")
    + ("slotmachines", "pharmacies-med", "sexcams", "pornos", "clicktrack", "jackpotslots", "torrent-crack", "webcamsex"),
    "allow": ("river-news", "state-archive", "public-library-north", "garden-journal", "mountain-club", "python-docs", "music-school", "city-museum", "weather-station",
              "cooking-notes", "kunsthalle", "gemeinde-nord", "ecole-primaire", "mairie-sud", "biblioteca-norte")
    + ("quandlom", "verriss", "thornwick", "lumidor", "esterhazy", "paltonen", "ombrellino", "zurtheck"),
}


def test_url_classifier_on_hosts_like_the_labels(spark):
    model = url_filter.train(url_filter.default_labels(spark))
    known = " ".join(url_filter.BLOCKED_HOSTS + url_filter.ALLOWED_HOSTS)
    urls = [(v, f"https://{p}{h}.other.org/{path}") for v, hosts in LIKE_LABELS.items() for h in hosts for p in ("", "www.") for path in ("en/17", "de/40123.html", "")]
    assert not any(h in known for hosts in LIKE_LABELS.values() for h in hosts)
    found = url_filter.judge(spark.createDataFrame(urls, "truth string, url string"), [], model).groupBy("truth", "verdict").count().collect()
    n = {(r.truth, r.verdict): r["count"] for r in found}
    right = n["block", "block"]
    precision, recall = right / (right + n.get(("allow", "block"), 0)), right / (right + n.get(("block", "allow"), 0))
    print(f"precision {precision:.3f}, recall {recall:.3f} of block")
    assert precision >= 0.9 and recall >= 0.8


def test_pipeline_stages_on_edges(spark, edge, tmp_path):
    docs = edge.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for start in (docs, docs.limit(0)):
        now = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, "")
            path = f"{tmp_path}/{i}-{start is docs}"
            now.write.parquet(path)
            now = spark.read.parquet(path)
            assert i == 4 or now.columns == before.columns, name


def test_later_stages_on_edges(spark, edge):
    """Those after the quality rules, which leave little of such rows."""
    docs = edge.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() > 0, name


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns named like an operator's results, and none that isn't needed."""
    rng = np.random.default_rng(3)
    syllables = ["sto", "ne", "ri", "ver", "lan", "tern", "mo", "un", "tain", "gar", "den"]
    texts = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(80)) for _ in range(40)]
    rows = [(i, t, f"s{i % 2}", f"size{i}", f"target{i}", i * 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string, n_words long")
    docs = docs.withColumn("n_removed", F.lit("r")).withColumn("copies", F.lit("c")).withColumn("posterior", F.lit(True))
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.dtypes == docs.dtypes, name
        found = left.collect()
        assert found and all(r == given[r.doc_id] for r in found), name


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
    assert DATA
