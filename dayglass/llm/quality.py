"""Operator 7, quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are all UTF-16 units (so no script is folded), digits as 0, one space between words,
and one mark for a word that equals the one before. Tasks count the 4-grams of their shard
of all documents, and of the trusted ones among them; the sums are tables of as many rows as
the corpus has n-grams. Joins of the count tables by n-gram, context and suffix, order by
order, give the loss (negative log probability) of every n-gram that any document holds,
seen in trusted text or not.

A document's score is the mean loss of its symbols, the log of its perplexity. Each task
gets the losses of the most frequent n-grams, at most Model.held of them; a document's other
n-grams go through a join with the whole loss table. Documents above the exact quantile of
trusted documents of their language, plus a margin, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.byte_words import by_bytes
from dayglass.llm.collocations import Ranks
from dayglass.llm.common import stored, texts, use_memo
from dayglass.llm.words import mix
from dayglass.operators.quantiles import quantiles

ORDER, BITS = 4, 16
REPEAT = "\x01"
_DIGITS = {k: "0" for k in map(ord, "123456789")}
#: N-grams that a task adds up before it sends them.
SENT = 1 << 20
#: Trusted ids, and languages, up to which their table is broadcast; beyond that Spark joins by shuffle.
IDS, LANGUAGES = 1_000_000, 10_000


@dataclass(frozen=True)
class Rule:
    """Reject above the `quantile` of trusted documents of a language plus `margin` nats."""

    quantile: float = 0.99
    margin: float = 0.35
    held: int = 1 << 20


def ngrams(text: str) -> np.ndarray:
    """The 4-grams of a text as four units in one number, one for each symbol after the opening spaces."""
    words = text.replace(REPEAT, " ").translate(_DIGITS).split()
    marked = "".join([" " + w if w != before else REPEAT for w, before in zip(words, ["", *words])])
    if not marked:
        return np.zeros(0, "u8")
    s = np.frombuffer(("  " + marked).encode("utf-16-le", "surrogatepass"), "<u2").astype("u8")
    out = s[:-3]
    for k in range(1, ORDER):
        out = (out << np.uint64(BITS)) | s[k : len(s) - ORDER + 1 + k]
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n, trusted: occurrences in all whole texts and in those whose column `trusted` is true."""

    def sent(grams: list[np.ndarray], n: list[np.ndarray], t: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        all_, place = np.unique(np.concatenate(grams), return_inverse=True)
        return all_, *(np.bincount(place, np.concatenate(c), len(all_)).astype("i8") for c in (n, t))

    def batch_of(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums[0].view("i8")), pa.array(sums[1]), pa.array(sums[2])], ["gram", "n", "trusted"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memo(None)
        grams, n, t, held = [], [], [], 0
        for part in by_bytes(batches, "text"):
            found = [ngrams(x) for x in texts(part.column(0))]
            sure = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), [len(f) for f in found])
            every = np.concatenate(found)
            some, place = np.unique(every, return_inverse=True)
            grams.append(some)
            n.append(np.bincount(place, minlength=len(some)))
            t.append(np.bincount(place, sure, len(some)).astype("i8"))
            held += len(some)
            if held > SENT:
                sums = sent(grams, n, t)
                if len(sums[0]) > SENT // 2:
                    yield batch_of(sums)
                    grams, n, t, held = [], [], [], 0
                else:
                    (grams, n, t), held = ([s] for s in sums), len(sums[0])
                    grams, n, t = list(grams), list(n), list(t)
        if held:
            yield batch_of(sent(grams, n, t))

    shards = docs.select("text", "trusted").mapInArrow(count, "gram bigint, n bigint, trusted bigint")
    return shards.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    n1, n2, n3, n4 = (v or 0 for v in counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    steps = [(n1, n2, 1), (n2, n3, 2), (n3, n4, 3)]
    return [max(0.0, k - (k + 1) * y * above / own) if own else k * y / 2 for own, above, k in steps]


def _suffix(order: int) -> Column:
    """The last order - 1 symbols of an n-gram of that order."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def losses(counts: DataFrame) -> DataFrame:
    """gram, n, loss of every 4-gram of the table gram_counts, by the model of its trusted counts.

    Without any trusted text all units are equally likely.
    """
    levels = {ORDER: counts.where("trusted > 0").select("gram", F.col("trusted").alias("n"))}
    asked = {ORDER: counts.select("gram")}
    for order in range(ORDER - 1, 0, -1):  # below the top: in how many contexts an n-gram follows
        shorter = _suffix(order + 1).alias("gram")
        levels[order] = stored(levels[order + 1].select(shorter).groupBy("gram").agg(F.count("*").alias("n")), "ngrams")
        asked[order] = stored(asked[order + 1].select(shorter).distinct(), "asked")
    below = None
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[order])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("gram", BITS).alias("context")
        seen = levels[order].select("gram", context, "n", discount.alias("d"))
        contexts = seen.groupBy("context").agg(F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("rest"))
        rows = asked[order].join(seen.drop("context"), "gram", "left").withColumn("context", context).join(contexts, "context", "left")
        lower = F.lit(1.0 / (1 << BITS))
        if below is not None:
            rows = rows.withColumn("suffix", _suffix(order)).join(below, "suffix")
            lower = F.col("lower")
        own = F.coalesce((F.col("n") - F.col("d")) / F.col("all"), F.lit(0.0))
        level = rows.select("gram", (own + F.coalesce("rest", F.lit(1.0)) * lower).alias("p"))
        below = stored(level.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "level")
    return counts.select("gram", "n").join(below.withColumnRenamed("suffix", "gram"), "gram").select("gram", "n", (-F.log("lower")).alias("loss"))


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent n-grams (at most `most`) and their losses; and whether these are all."""
    top = table.orderBy(F.desc("n"), "gram").limit(most).select("gram", "loss").toArrow()
    return top["gram"].to_numpy().view("u8"), top["loss"].to_numpy(), table.count() <= most


def with_nats(docs: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """`docs` with a column __nats: the mean loss of a symbol; 0 for a text without words."""
    grams, loss, whole = _frequent(table, most)
    shared = docs.sparkSession.sparkContext.broadcast((grams, loss))
    ranks: list[Ranks] = []

    def judged(column: pa.Array) -> Iterator[tuple[float, int, np.ndarray]]:
        use_memo(None)
        if not ranks:
            ranks.append(Ranks(mix(shared.value[0])))
        for text in column:
            found = ngrams(text.as_py() or "")
            rank = ranks[0].of(mix(found))
            known = rank >= 0
            yield float(shared.value[1][rank[known]].sum()), len(found), found[~known]

    if whole:

        def mean(column: pa.Array) -> pa.Array:
            return pa.array([total / n if n else 0.0 for total, n, _ in judged(column)], pa.float64())

        # declared so, a filter on it is not evaluated a second time below the join with the limits
        return docs.withColumn("__nats", F.arrow_udf(mean, "double").asNondeterministic()(F.col("text")))

    parts = pa.struct([("total", pa.float64()), ("n", pa.int64()), ("rest", pa.list_(pa.int64()))])

    def split(column: pa.Array) -> pa.Array:
        return pa.array([{"total": total, "n": n, "rest": rest.view("i8")} for total, n, rest in judged(column)], parts)

    # a score depends on the text alone, so each text is judged once
    key = F.unhex(F.sha1(F.coalesce("text", F.lit("")).cast("binary"))).alias("__text")
    texts_ = docs.select(key, "text").dropDuplicates(["__text"])
    some = stored(texts_.select("__text", F.arrow_udf(split, "struct<total:double,n:bigint,rest:array<bigint>>")("text").alias("s")), "partly")
    rest = some.select("__text", F.explode("s.rest").alias("gram")).groupBy("__text", "gram").agg(F.count("*").alias("times"))
    rest = rest.join(table, "gram").groupBy("__text").agg(F.sum(F.col("times") * F.col("loss")).alias("more"))
    total = (F.col("s.total") + F.coalesce("more", F.lit(0.0))) / F.col("s.n")
    nats = some.join(rest, "__text", "left").select("__text", F.when(F.col("s.n") > 0, total).otherwise(0.0).alias("__nats"))
    return docs.withColumn("__text", key).join(nats, "__text").drop("__text")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that are labelled as good and never as bad."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )


def small(table: DataFrame, most: int) -> DataFrame:
    """A narrow table, to be broadcast if it has no more than `most` rows."""
    table = stored(table, "narrow")
    return F.broadcast(table) if table.count() <= most else table


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def thresholds(scores: DataFrame, rule: Rule) -> tuple[DataFrame, float]:
    """language, threshold from the scores (lang, nats) of trusted documents, exactly; and the one of all languages."""
    at = F.get("quantiles", F.lit(0)) + rule.margin
    by = quantiles(scores.select(_language().alias("language"), "nats"), "nats", (rule.quantile,), ["language"])
    all_ = quantiles(scores, "nats", (rule.quantile,)).select(at.alias("threshold")).first()
    return by.select("language", at.alias("threshold")), all_["threshold"] if all_ else float("inf")


def _model(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    sure = trusted.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__sure"))
    texts_ = docs.select("doc_id", "text").join(sure, F.col("doc_id") == F.col("__id"), "left")
    counts = stored(gram_counts(texts_.select("text", F.col("__sure").isNotNull().alias("trusted"))), "grams")
    return stored(losses(counts), "losses")


def classify(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every document.

    The model learns from all documents labelled quality 1. A document without words and
    one whose doc_id or lang is null are scored alike; with no trusted document at all
    every document stays. `keep` is false above the threshold.
    """
    trusted = small(trusted_ids(labels), IDS)
    model = _model(docs, trusted)
    rows = docs.select("doc_id", "lang", "text")
    scored = stored(with_nats(rows, model, rule.held).select("doc_id", "lang", F.col("__nats").alias("nats")), "scores")
    by, anywhere = thresholds(scored.join(trusted, "doc_id", "left_semi"), rule)
    limited = scored.withColumn("language", _language()).join(small(by, LANGUAGES), "language", "left")
    limit = F.coalesce("threshold", F.lit(anywhere))
    return limited.select("doc_id", "lang", F.exp("nats").alias("perplexity"), F.exp(limit).alias("threshold"), (F.col("nats") <= limit).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs` that the classifier keeps, all columns as they were."""
    trusted = small(trusted_ids(labels), IDS)
    model = _model(docs, trusted)
    own = docs.select("doc_id", "lang", "text").join(trusted, "doc_id", "left_semi")
    scored = stored(with_nats(own, model, rule.held).select("lang", F.col("__nats").alias("nats")), "scores")
    by, anywhere = thresholds(scored, rule)
    limits = small(by.select(F.col("language").alias("__language"), F.col("threshold").alias("__threshold")), LANGUAGES)
    judged = with_nats(docs, model, rule.held).join(limits, _language() == F.col("__language"), "left")
    kept = judged.where(F.col("__nats") <= F.coalesce("__threshold", F.lit(anywhere)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
