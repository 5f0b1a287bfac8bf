"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm import ann, collocations, conversations, fingerprints, jaccard_join, near_dedup, packing, quality, sentencepiece_codec, substring, token_counts, toxicity, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; only tokens bind."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Capacity(tokens=2048))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and where 512 of them end."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and whether they decode to it."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encoding_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


_GROUP = "translate(lpad(upper(to_base(('0x' || substr(hex, {0}, 10))::bigint, 32)), 8, '0'), '{1}', '{2}')"
ORACLE["op9_warc"] = f"""
with digests as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
    select page_id, payload_bytes, max(page_id) over (partition by hex) as kept,
           {" || ".join(_GROUP.format(k, warc.PLAIN_DIGITS, warc.RFC_DIGITS) for k in (1, 11, 21, 31))} as payload_digest
    from digests
)
select page_id, payload_bytes, payload_digest,
       case when page_id < kept then 'revisit' else 'response' end as record_type,
       case when page_id < kept then kept end as refers_to
from named
"""


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every twentieth, among all."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next one."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a lexicon learned from the labels that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the trusted ones, and its language's threshold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its class of texts that are alike by 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words that start earlier elsewhere."""
    return substring.removal_digest(table(spark, sf_dir, "documents"))


ORACLE["op8_substring_dedup"] = r"""
with texts as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), placed as (
    select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from texts
), windows as (
    select doc_id, pos, string_agg(word, ' ') over w as passage, count(*) over w as n
    from placed window w as (partition by doc_id order by pos rows between current row and 19 following)
), late as (
    select doc_id, pos from windows where n = 20
    qualify row_number() over (partition by passage order by doc_id, pos) > 1
), removed as (
    select distinct doc_id, unnest(generate_series(pos, pos + 19)) as pos from late
), kept as (
    select p.doc_id, count(r.pos) as n_removed,
           string_agg(p.word, ' ' order by p.pos) filter (where r.pos is null) as kept_text
    from placed p left join removed r on p.doc_id = r.doc_id and p.pos = r.pos group by p.doc_id
)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(k.n_removed, 0) as n_removed,
       sha256(coalesce(k.kept_text, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id
"""


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts whose three-word shingles are alike by 0.9."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_jaccard_join"] = rf"""
with recursive texts as (
    select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
    select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
    from texts
), sizes as (
    select r, count(*) as n from shingles group by r
), common as (
    select a.r as a, b.r as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.r < b.r group by all
), links as (
    select a, b from common join sizes x on x.r = a join sizes y on y.r = b where 100 * k >= 90 * (x.n + y.n - k)
), both_ways as (
    select a, b from links union all select b, a from links
), reach as (
    select r, r as t from texts union select reach.r, both_ways.b from reach join both_ways on both_ways.a = reach.t
)
select x.doc_id, coalesce(n, 0) as n_shingles, component_id
from texts x left join sizes using (r)
join (select reach.r, min(y.doc_id) as component_id from reach join texts y on y.r = reach.t group by reach.r) using (r)
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and the cheapest edits that mend it."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases of two to four words that stick together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = rf"""
with texts as (
    select row_number() over () as r, coalesce(lang, 'und') as lang, {_LOWER} as text from documents
), pieces as (
    select r, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts
), lists as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from lists, range(1, 5) t(k) where len(w) >= k)
), counts as materialized (
    select lang, phrase, k, count(*) as f from grams group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), phrases as materialized (
    select lang, k, phrase, string_split(phrase, ' ') as w, f as a from counts where k > 1 and f >= 30
), cuts as materialized (
    select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:k], ' ') as tail
    from (select *, unnest(range(1, k)) as cut from phrases)
), scored as (
    select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, 2000000::hugeint * c.a // (x.f::hugeint + y.f) as score
    from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.tail
), worst as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inside as (
    select lang, a as f, array_to_string(w[i:i + size - 1], ' ') as phrase
    from (select lang, a, w, size, unnest(range(1, k - size + 2)) as i from phrases, range(2, 4) t(size) where size < k)
), longer as (
    select lang, phrase, max(f) as f from inside group by all
), kept as (
    select w.* from worst w left join longer g on g.lang = w.lang and g.phrase = w.phrase
    where g.f is null or 100::hugeint * g.f < 80::hugeint * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000
"""
