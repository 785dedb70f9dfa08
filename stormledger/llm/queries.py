"""The registered queries of this subpackage: each applies its operator to its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import encode_documents
from .common import read_table
from .decontaminate import contaminated
from .filter_audit import audit_filters
from .multiset_hash import edited_fingerprints
from .repetition import quality_rules
from .secrets import scan_secrets
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring_dedup import repeated_passages
from .token_counts import count_tokens
from .token_shards import token_shards
from .toxicity import toxicity
from .warc import archive_pages


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_multiset_hash": op4_multiset_hash,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_token_shards": op7_token_shards,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_repetition": op11_repetition,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling": op13_spelling,
}

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        q as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first_id from p)
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
          list_aggregate(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as int), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), 'string_agg', '') as payload_digest,
          case when page_id = first_id then 'response' else 'revisit' end as record_type,
          case when page_id = first_id then null else first_id end as refers_to
        from q
    """,
    "op11_repetition": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        lines as (select doc_id, line, count(*) as c, any_value(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) as chars
          from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line),
        repeats as (select doc_id, sum(c - 1) as n_dup_lines, sum((c - 1) * chars) as dup_line_chars from lines group by doc_id),
        places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
        grams as (select doc_id, i, n, length(w[i]) as chars, case when i + n - 1 <= len(w) then hash(w[i:i + n - 1]) end as gram, w[i:i + n - 1] as words from places, (values (3), (5), (6), (7), (8), (9), (10)) as lengths(n)),
        marked as (select doc_id, i, n, chars, gram is not null and count(*) over (partition by doc_id, n, gram, words) > 1 as twice from grams),
        inside as (select doc_id, n, chars, max(twice) over (partition by doc_id, n order by i rows between n - 1 preceding and current row) as covered from marked),
        shares as (select doc_id, count(*) filter (n = 3 and covered) as n_repeat_words, sum(chars) filter (n = 5 and covered) as c5, sum(chars) filter (n = 6 and covered) as c6,
          sum(chars) filter (n = 7 and covered) as c7, sum(chars) filter (n = 8 and covered) as c8, sum(chars) filter (n = 9 and covered) as c9, sum(chars) filter (n = 10 and covered) as c10 from inside group by doc_id),
        m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
          cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(dup_line_chars, 0) as bigint) as dup_line_chars,
          cast(coalesce(c5, 0) as bigint) as dup_5gram_chars, cast(coalesce(c6, 0) as bigint) as dup_6gram_chars, cast(coalesce(c7, 0) as bigint) as dup_7gram_chars,
          cast(coalesce(c8, 0) as bigint) as dup_8gram_chars, cast(coalesce(c9, 0) as bigint) as dup_9gram_chars, cast(coalesce(c10, 0) as bigint) as dup_10gram_chars
          from d left join repeats using (doc_id) left join shares using (doc_id))
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
          not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (100 * dup_line_chars > 30 * word_chars or 100 * dup_5gram_chars > 45 * word_chars or 100 * dup_6gram_chars > 42 * word_chars
            or 100 * dup_7gram_chars > 39 * word_chars or 100 * dup_8gram_chars > 36 * word_chars or 100 * dup_9gram_chars > 33 * word_chars or 100 * dup_10gram_chars > 30 * word_chars) as kept
        from m
    """,
    "op12_filter_audit": r"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        f as (select d.doc_id, part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
          (case when len(w) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end) ||
          (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 'C' else '' end) ||
          (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as fails
          from d left join labels on labels.doc_id = d.doc_id),
        c as (select part, good, toxic, fails, count(*) as n from f group by all),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
        orders as (select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
          where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
        s as (select filter_order, cast(step as int) as step, substr(filter_order, cast(step as int), 1) as l, '[' || left(filter_order, cast(step as int) - 1) || '0]' as before from orders, range(1, 6) as steps(step)),
        r as (select part, filter_order, step, l,
          sum(n) filter (not contains(fails, l) and not regexp_matches(fails, before)) as kept, sum(n) filter (contains(fails, l) and not regexp_matches(fails, before)) as removed,
          sum(n) filter (contains(fails, l) and regexp_matches(fails, before)) as redundant, sum(n) filter (fails = l) as unique_fails,
          sum(n) filter (good and contains(fails, l) and not regexp_matches(fails, before)) as good_lost, sum(n) filter (toxic and contains(fails, l) and not regexp_matches(fails, before)) as toxic_lost
          from c, s group by part, filter_order, step, l)
        select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
          cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
          cast(sum(coalesce(removed, 0)) over (partition by part, l) as bigint) as shapley
        from r
    """,
}
