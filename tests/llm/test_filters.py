import random
from collections import Counter

import numpy as np
import public_tokenizers  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dayglass.llm import quality, toxicity
from dayglass.llm.quality import BITS, ORDER, ngrams


def kneser_ney(texts, asked):
    """Interpolated modified Kneser-Ney by its definition, on dictionaries of symbol tuples."""
    unpack = lambda g: tuple((int(g) >> BITS * k) & 0xFFFF for k in reversed(range(ORDER)))
    counts = {ORDER: Counter(unpack(g) for t in texts for g in ngrams(t))}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    steps, totals, off = {}, {}, {}
    for order, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        steps[order] = [max(0, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else k * y / 2 for k in (1, 2, 3)]
        for g, times in c.items():
            totals[g[:-1]] = totals.get(g[:-1], 0) + times
            off[g[:-1]] = off.get(g[:-1], 0) + steps[order][min(times, 3) - 1]

    def p(g):
        if not g:
            return 1 / 65536
        c, context = counts[len(g)][g], g[:-1]
        own = (c - steps[len(g)][min(c, 3) - 1]) / totals[context] if c else 0
        return own + (off[context] / totals[context] if context in totals else 1) * p(g[1:])

    return {int(g): p(unpack(g)) for g in asked}


def test_model_by_definition(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()
    texts = [r.text for r in rows] + ["ЖЗИ кухня ок", "emoji 😀😀 x", None]
    docs = spark.createDataFrame([(t, k % 3 != 0) for k, t in enumerate(texts)], "text string, trusted boolean")
    table = quality.losses(quality.gram_counts(docs)).collect()
    got = {r.gram % 2**64: np.exp(-r.loss) for r in table}
    every = np.concatenate([ngrams(t or "") for t in texts])
    want = kneser_ney([t or "" for k, t in enumerate(texts) if k % 3 != 0], set(every.tolist()))
    assert got.keys() == want.keys() and all(np.isclose(got[g], want[g], rtol=1e-9) for g in want)
    assert {r.gram % 2**64: r.n for r in table} == Counter(every.tolist())


def test_repeats_are_marks():
    assert len(ngrams("a a a")) == 3 and len(ngrams("")) == len(ngrams(" \n")) == 0
    assert int(ngrams("ab ab")[-1]) % 65536 == ord(quality.REPEAT)


def test_rare_ngrams_by_join_give_the_same_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    one, two = (sorted(map(tuple, quality.classify(docs, labels, quality.Rule(held=held)).collect()), key=str) for held in (1 << 20, 300))
    assert len(one) == len(two) == docs.count()
    assert all(x[:2] == y[:2] and np.allclose(x[2:4], y[2:4]) and x[4] == y[4] for x, y in zip(one, two))
    kept = [quality.keep_good(docs, labels, quality.Rule(held=held)).count() for held in (1 << 20, 300)]
    assert kept[0] == kept[1] == sum(x[4] for x in one)


def test_gibberish_of_any_script_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rng = random.Random(2)
    letters = ["".join(map(chr, range(a, b))) for a, b in ((65, 91), (97, 123), (0x430, 0x450), (0x4E00, 0x4F00), (0x627, 0x64A))]
    junk = [" ".join("".join(rng.choices(alphabet, k=rng.randint(2, 8))) for _ in range(120)) for alphabet in letters]
    good = docs.join(labels.where("quality = 1"), "doc_id").first()["text"]
    mixed = list(good)
    rng.shuffle(mixed)
    rows = [(10**6 + k, t, "en") for k, t in enumerate([*junk, "XQZ KWV BBB " * 60, "".join(mixed)])]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    keep = {r.doc_id: r.keep for r in quality.classify(more, labels).collect()}
    assert not any(keep[r[0]] for r in rows)


def test_classifier_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect() if r.quality is not None]
    assert len(rows) == docs.count()
    assert np.mean([keep for good, keep in truth if good]) > 0.98
    assert np.mean([keep for good, keep in truth if not good]) < 0.35


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(labelled, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" scum": 4.0, " idiot ": 5.0}, [" scumbie "])
    automaton = lexicon.automaton()
    total = lambda t: toxicity.total_weight(toxicity.fold(t), automaton)
    assert total("You SCUM") == total("you, ѕсυm!") == total("$cum") == total("s­cum") == 4.0
    assert total("1d10t") == 5.0 and total("idiotic") == 0.0 and total("ascum") == 0.0
    assert total("scumble") == 0.0 and total("scumble scummy") == 4.0 and total("") == 0.0


def test_edge_rows(edge, empty, labels):
    for keep in (quality.keep_good, toxicity.keep_civil):
        assert keep(edge, labels).columns == edge.columns
        assert keep(empty, labels).count() == 0
        assert keep(edge, labels.where("false")).count() == edge.count()
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == edge.count() and all(r.keep for r in rows if r.doc_id in (2, 3, 4))
    scored = toxicity.toxicity(edge, labels).collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.classify(empty, labels).count() == toxicity.toxicity(empty, labels).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "toxicity", "near_dedup", "substring_dedup", "best_fit_packing",
    ]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        rows = [tuple(r) for r in after.collect()]
        assert {r[0] for r in rows} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, packed.drop("sequence_id", "offset").collect())
    )


@pytest.mark.parametrize("texts", [[""], ["a"], ["x y z"], []])
def test_tiny_training_sets(spark, texts):
    docs = spark.createDataFrame([(t, True) for t in texts] + [("other words", False)], "text string, trusted boolean")
    table = quality.losses(quality.gram_counts(docs)).collect()
    assert len(table) == len({g for t in [*texts, "other words"] for g in ngrams(t).tolist()})
    assert all(np.isfinite(r.loss) and r.loss >= 0 for r in table)
