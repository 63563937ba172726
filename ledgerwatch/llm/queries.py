"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import pii_crf

    found = pii_crf.find(table(spark, sf_dir, "documents"), "doc_id", "text", pii_crf.standard_field())

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op2_warc", sql="""
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest,
       case when page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id > first then first end as refers_to
from (select page_id, h, case when strlen(h) >= 100 then min(page_id) over (partition by h) end as first
      from (select page_id, coalesce(html, '') as h from pages))
""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import warc_zst

    records = warc_zst.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_license_scan")
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import license_scan

    found = license_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@query("op4_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import token_file

    found = token_file.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query("op5_byte_bpe")
def byte_bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerwatch.llm import byte_bpe

    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text",
                                vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _quality_sql() -> str:
    """The quality query in SQL: measures, votes, then expectation-maximisation as a recursive query."""
    from ledgerwatch.llm.quality_votes import LEAST, MOST, MOST_ON_GOOD, ROUNDS, RULES, starting_rates

    numbers, (shares, rates) = range(1, len(RULES) + 1), starting_rates()
    classes = range(1, len(shares) + 1)
    votes = ", ".join(
        f"case when n_words = 0 then 0 when {good.replace('x ', f'({m}) ')} then 1 when {bad.replace('x ', f'({m}) ')} then -1 else 0 end"
        for _, m, good, bad in RULES)
    logs = [f"ln(share[{c}]) + " + " + ".join(
        f"case votes[{j}] when -1 then ln(against[{c}][{j}]) when 1 then ln(1 - against[{c}][{j}]) else 0 end" for j in numbers) for c in classes]
    chances = "[" + ", ".join("1 / (" + " + ".join(f"exp(least(700, l{f} - l{c}))" for f in classes) + ")" for c in classes) + "]"
    named_logs = ", ".join(f"{x} as l{c}" for c, x in zip(classes, logs))
    new_share = ", ".join(f"least({MOST}, greatest({LEAST}, (sum(n * q[{c}]) + 0.5e0) / (sum(n) + 1e0)))" for c in classes)
    new_rates = ", ".join("[" + ", ".join(
        f"least({MOST_ON_GOOD if c == 1 else MOST}, greatest({LEAST}, (sum(if(votes[{j}] = -1, n * q[{c}], 0e0)) + {2 * rates[c - 1][j - 1]!r}e0)"
        f" / (sum(if(votes[{j}] = 0, 0e0, n * q[{c}])) + 2e0)))" for j in numbers) + "]" for c in classes)
    return f"""
with recursive words as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from (select doc_id, coalesce(text, '') as t from documents)
), windows as (
  select doc_id, i, count(*) over (partition by doc_id, w) as times
  from (select doc_id, i, array_to_string(words[i : i + 4], ' ') as w
        from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from words where len(words) >= 5))
), repeated as (
  select doc_id, count(distinct i + k) as n from windows, range(0, 5) r(k) where times > 1 group by doc_id
), measured as (
  select doc_id, cast(len(words) as bigint) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
         length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) as n_ends, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
         length(t) - length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x20\\x09-\\x0D]', '', 'g')) as n_marks
  from words left join repeated using (doc_id)
), voted as (select *, [{votes}] as votes, n_words < 10 or 100 * n_repeat_words > 20 * n_words as failed from measured
), patterns as (select votes, cast(count(*) as double) as n from voted where not failed group by votes
), em(r, share, against) as (
  select 0, [{", ".join(f"{x!r}e0" for x in shares)}], [{", ".join("[" + ", ".join(f"{x!r}e0" for x in row) + "]" for row in rates)}]
  union all
  select any_value(r) + 1, [{new_share}], [{new_rates}]
  from (select r, n, votes, {chances} as q from (select r, n, votes, {named_logs} from em, patterns where r < {ROUNDS})) having count(*) > 0
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed,
       not failed and ({chances})[1] >= 0.5 as kept
from (select *, {named_logs} from voted, (select share, against from em where r = {ROUNDS}))
"""


@query("op6_quality_votes", sql=_quality_sql())
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import quality_votes

    found = quality_votes.judged(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


@query("op7_tag_paths")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import tag_paths

    found = tag_paths.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op8_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import simhash_ring

    found = simhash_ring.groups(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op9_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import toxicity_gru

    documents = table(spark, sf_dir, "documents")
    net = toxicity_gru.train(documents, table(spark, sf_dir, "labels"))
    found = toxicity_gru.score(documents, "doc_id", "text", net)
    return found.select(F.col("id").alias("doc_id"), toxicity_gru.in_test_part(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_decontamination", sql="""
with item_words as (
  select item_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') as words
  from (select distinct item_id, text from benchmark)
), grams as (
  select distinct item_id, words, array_to_string(words[i : least(i + 4, len(words))], ' ') as gram
  from (select item_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from item_words where len(words) > 0)
), items as (select item_id, words, count(*) as n from grams group by all),
doc_words as (
  select doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') as words from documents
), doc_grams as (
  select doc_id, size, array_to_string(words[i : i + size - 1], ' ') as gram
  from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i from doc_words, (select distinct least(5, len(words)) as size from item_words where len(words) > 0) s where len(words) >= size)
), shared as (
  select d.doc_id, g.item_id, g.words, count(distinct g.gram) as shared
  from doc_grams d join grams g on d.gram = g.gram and d.size = least(5, len(g.words)) group by all
)
select doc_id, item_id, n as n_shingles, shared as n_shared, round(shared / n, 6) as containment
from shared join items using (item_id, words) where shared >= ceil(0.8 * n - 1e-9)
""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import containment

    found = containment.contained(table(spark, sf_dir, "documents"), "doc_id", "text",
                                  table(spark, sf_dir, "benchmark"), "item_id", "text", size=5, least=0.8)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared",
                        F.round("containment", 6).alias("containment"))


@query("op11_phrases", sql="""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), worded as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as words from pieces
), grams as (
  select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase
  from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from worded, range(1, 5) r(k) where len(words) >= k)
), counted as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30
), candidates as (select * from counted where k > 1
), dropped as (
  select distinct c.lang, c.phrase from candidates c join candidates d on c.lang = d.lang and d.k > c.k
    and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') where 100 * d.f >= 80 * c.f
), cuts as (
  select c.lang, c.phrase, c.f as a, cut, x.f as l, y.f as r, (2000000 * cast(c.f as hugeint)) // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from candidates) c
  join counted x on x.lang = c.lang and x.phrase = array_to_string(w[1 : cut], ' ')
  join counted y on y.lang = c.lang and y.phrase = array_to_string(w[cut + 1 : ], ' ')
  where (c.lang, c.phrase) not in (select (lang, phrase) from dropped)
), lowest as (
  select *, row_number() over (partition by lang, phrase order by score, cut) as turn from cuts
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest where turn = 1
)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from ranked join (select lang, cast(sum(len(words)) as bigint) as n from worded group by lang) using (lang) where rank <= 2000
""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import phrase_graph

    return phrase_graph.collocations(table(spark, sf_dir, "documents"), "text", "lang", least=30, top=2000, covered=80)


@query("op12_mixing", sql="""
with rows_ as (
  select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, ''))[1:15] as hash
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from rows_ group by source
), bounded as (
  select *, coalesce(sum(2 * source_size) over (order by 2 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by 2 * source_size / w, source nulls last rows between current row and unbounded following) as onward
  from sources
), level as (
  select max((1.5e0 * total - before) / onward) as level from bounded, (select cast(sum(size) as double) as total from rows_)
), planned as (
  select source, source_size, least(cast(2 * source_size as double), level * w) as target,
         case when source_size > 0 then cast(floor(least(cast(2 * source_size as double), level * w) / source_size) as bigint) else 0 end as whole
  from sources, level
), sums as (
  select source, hash, sum(size) as size, sum(sum(size)) over (partition by source order by hash) as upto from rows_ group by source, hash
)
select doc_id, r.size, source_size, target,
       cast(r.size * (whole + case when upto <= rest or (upto - s.size <= rest and 2 * (rest - (upto - s.size)) > s.size) then 1 else 0 end) as bigint) as taken
from rows_ r join sums s on r.source is not distinct from s.source and r.hash = s.hash
join (select *, target - whole * source_size as rest from planned) p on r.source is not distinct from p.source
""")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import mixing as mix

    found = mix.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", weights=(3, 1, 2), shares=(1.5,), most=2)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target")[0].alias("target"),
                        F.col("taken")[0].alias("taken"))


@query("op13_ranked_search", sql="""
with doc_terms as (
  select row_number() over () as row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), whole as (select count(*) as n_docs, cast(sum(len(terms)) as hugeint) as n_all from doc_terms where len(terms) > 0
), items as (
  select row_number() over () as item_no, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from (select distinct item_id, text from benchmark)
), asked as (select item_no, term, count(*) as times from (select item_no, unnest(terms) as term from items) group by all
), held as (
  select row_no, term, count(*) as tf from (select row_no, unnest(terms) as term from doc_terms) where term in (select term from asked) group by all
), weights as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from held, whole group by term
), scores as (
  select item_no, row_no, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weights using (term) join held using (term)
  join (select row_no, cast(100 - 75 + (75 * cast(len(terms) as hugeint) * n_docs) // n_all as bigint) as m from doc_terms, whole where len(terms) > 0) using (row_no)
  group by item_no, row_no having score > 0
), ranked as (
  select item_id, item_no, doc_id, score, cast(row_number() over (partition by item_no order by score desc, doc_id nulls last) as integer) as rank
  from scores join items using (item_no) join (select row_no, doc_id from doc_terms) using (row_no)
)
select item_id, rank, doc_id, score from ranked where rank <= 10
""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm import ranked_search as ranked

    found = ranked.search(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
