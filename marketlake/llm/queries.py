"""The registered queries of this subpackage: thin views of the operators with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import (
    best_fit_packing, bpe_codec, id_files, language_id, ngram_jaccard, norm_buckets, prefix_forest, prefix_trie, quality_fm, repeated_spans,
    token_alignment, token_counts, toxicity_cnn)
from marketlake.llm.common import held_out, read_table
from marketlake.session import shared_dir

#: Fixed values of the classifiers' contracts: a score from here on predicts label 1.
TOXIC_FROM = 0.5
QUALITY_FROM = 0.3
METADATA = ("n_chars",)


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.join_groups(read_table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every page and every document: language, posterior, and the language by the text alone."""
    docs = read_table(spark, folder, "documents")
    rows = language_id.page_rows(read_table(spark, folder, "pages")).unionByName(language_id.document_rows(docs))
    return language_id.identify(rows, docs.select("text", "lang"))


def op3_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.encode_documents(read_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing.pack(read_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op5_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_forest.search(read_table(spark, folder, "embeddings"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return norm_buckets.search(read_table(spark, folder, "embeddings"))


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= least).cast("int").alias("predicted"))


def op8_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return _predicted(toxicity_cnn.score_documents(docs, read_table(spark, folder, "labels")), TOXIC_FROM)


def op9_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", *METADATA)
    return _predicted(quality_fm.score_documents(docs, read_table(spark, folder, "labels"), metadata=METADATA, threshold=QUALITY_FROM), QUALITY_FROM)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the text without repeated passages, the lines that went, and the words that went in repeated spans of what was left."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return repeated_spans.remove_passages(docs).select(
        "doc_id", "text", "removed_lines", F.size("removed_lines").alias("n_removed"), "removed_words")


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_documents(
        read_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, folder, "conversations"))


def op13_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """The id files of all documents, written to the shared folder and read back."""
    target = f"{shared_dir(spark)}/llm/id_files-{uuid.uuid4().hex}"
    id_files.write_ids(read_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), target)
    return id_files.read_ids(spark, target)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_language_id, op3_bpe_codec, op4_best_fit_packing, op5_prefix_forest, op6_token_counts, op7_norm_buckets, op8_toxicity_cnn,
    op9_quality_fm, op10_substring_dedup, op11_token_alignment, op12_prefix_trie, op13_id_files)}
#: Exact by all shingles that two documents share, links closed by recursion.
OP1_SQL = """
with recursive w as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * both_have >= 80 * (p.n + q.n - both_have)),
links as (select x, y from l union all select y, x from l),
reach as (select doc_id, doc_id as root from w union select reach.doc_id, links.y from reach join links on links.x = reach.root)
select doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(root) as component_id from reach left join n using (doc_id) group by doc_id"""

#: Equal rows count once; an id with several vectors asks with the least of them.
OP7_SQL = """
with u as (
  select distinct vec_id, [cast(x as double) for x in embedding] as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
a as (select vec_id, min(v) as v from u where vec_id % 100 = 0 group by vec_id),
c as (select vec_id, [floor(1024 * x) for x in v] as e from u),
q as (select vec_id, [floor(1024 * x) for x in v] as e from a),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from q join c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10"""

#: The crc32 of the decimal id, bit by bit; prefixes are lists of turn digests.
OP12_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (
  select conv_id, list(struct_pack(k := md5(concat(strlen(role), ':', role, text)), n := length(text)) order by turn nulls first, role, md5(text)) as turns
  from t group by conv_id),
h as (
  select conv_id, turns, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::bigint for i in range(8)]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 6 as h
  from own),
rebuilt as (
  select h.conv_id, list_concat(coalesce(own.turns[1:h.h], []), h.turns[h.h + 1:]) as turns from h left join own on own.conv_id = h.base),
steps as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt),
nodes as (
  select turns[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(any_value(turns[depth].n), 0) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(turns) = depth), '')) as ends_sha256
  from steps group by all),
children as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by all),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)),
above as (select node, saved, n_children, unnest(range(0, depth + 1)) as up from counted),
subtrees as (
  select node[1:up] as node, sum((n_children = 0)::bigint)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by all)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join subtrees using (node) left join nodes p on c.depth > 0 and p.node = c.node[1:c.depth - 1]"""

SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op7_norm_buckets": OP7_SQL, "op12_prefix_trie": OP12_SQL}
