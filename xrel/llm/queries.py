"""The operators applied to the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xrel.llm.decontaminate import benchmark_hits
from xrel.llm.divergence import source_divergences
from xrel.llm.mixing import mix
from xrel.llm.near_duplicates import near_duplicates
from xrel.llm.paragraphs import without_repeated_paragraphs
from xrel.llm.passages import without_repeated_passages
from xrel.llm.pieces import decode_ids, encode_texts
from xrel.llm.quality_model import quality_scores
from xrel.llm.quality_rules import STATISTICS, quality_verdicts
from xrel.llm.repeated_bytes import removed_bytes
from xrel.llm.secrets import joined_spans, secrets
from xrel.llm.shared import documents, new_path
from xrel.llm.token_counts import token_counts
from xrel.llm.token_files import token_index, write_tokens
from xrel.llm.whitening import whitened_embeddings

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 4096
END_ID = 1
PIECE_END_ID = 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken")
    )


OP1_SQL = r"""
with recursive sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '-' || md5(coalesce(text, '')))), 1, 12))::bigint
            / 281474976710656.0 as draw
    from documents),
sums as (
    select source, sum(size)::bigint as source_size,
        [5.0, 2.0, 1.0][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3]::double as weight
    from sized group by source),
whole as (select sum(source_size)::double as total from sums),
levels(step, level) as (
    select 0, 0.0::double
    union all
    select step + 1, (
        select (any_value(total) - coalesce(sum(3.0 * source_size) filter (3.0 * source_size < weight * level), 0))
            / sum(weight) filter (not 3.0 * source_size < weight * level) from sums, whole)
    from levels where step < 64),
final as (select max(level) as level from levels),
targets as (select source, source_size, least(3.0 * source_size, weight * level)::double as target from sums, final),
rated as (
    select doc_id, size, source_size, target, draw,
        case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end as rate
    from sized join targets on sized.source is not distinct from targets.source)
select doc_id, size, source_size, target,
    (floor(rate) + (draw < rate - floor(rate))::int)::bigint * size as taken
from rated
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
with docs as (
    select doc_id, row_number() over () as rid, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
items as (
    select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
windows as (
    select distinct item, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as win
    from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from items where len(w) > 0)),
sizes as (select distinct n from windows),
places as (
    select rid, n, unnest(range(1, len(w) - n + 2)) as s, w from docs, sizes where len(w) >= n),
hits as (
    select rid, s, p.n, item from places p join windows v
    on p.n = v.n and array_to_string(p.w[s : s + p.n - 1], ' ') = v.win),
covered as (
    select rid, count(distinct pos) as n_hit from (select rid, unnest(range(s, s + n)) as pos from hits) group by rid),
named as (
    select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names
    from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (rid) left join named using (rid)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_index(spark, path)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, then what still repeats exactly in the kept texts, within longer lines or over line ends."""
    kept = F.coalesce("kept_text", F.lit(""))
    lines = without_repeated_paragraphs(documents(spark, sf_dir)).select(
        "doc_id",
        "n_removed",
        F.size("removed").cast("bigint").alias("n_paragraphs"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("paragraphs"),
        F.sha2(kept, 256).alias("kept_sha256"),
        F.col("kept_text").alias("text"),
        F.col("n_shared").alias("n_shared_lines"),
    )
    width = F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return without_repeated_passages(lines, shared="n_shared_passages").select(
        "doc_id",
        "n_removed",
        "n_paragraphs",
        "paragraphs",
        "kept_sha256",
        F.size("passages").cast("bigint").alias("n_passages"),
        width.alias("n_passage_bytes"),
        F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",").alias("passages"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("rest_sha256"),
        # What goes because another document has it first, whole lines and passages together.
        (F.col("n_shared_lines") + F.col("n_shared_passages")).alias("n_shared"),
    )


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts.select("doc_id", *STATISTICS, "base_failed", "kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    as_spans = lambda name, kind: F.transform(
        name, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end"))
    )
    base, random = as_spans("base", lambda s: s["kind"]), as_spans("random", lambda s: F.lit(3))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(base, random).alias("spans"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_ids(encode_texts(documents(spark, sf_dir), model, PIECE_END_ID), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(documents(spark, sf_dir)).select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = r"""
with docs as (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
    from documents),
grp as (select distinct lang, source from docs),
words as (
    select d, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from docs),
kept as (select lang, term from words group by lang, term having count(distinct d) >= 10),
counts as (
    select lang, source, term, count(*)::hugeint as n from words semi join kept using (lang, term) group by lang, source, term),
v as (select g.lang, coalesce(any_value(k.v), 0)::hugeint as v
    from (select distinct lang from grp) g left join (select lang, count(*) as v from kept group by lang) k using (lang) group by g.lang),
total as (
    select g.lang, g.source, coalesce(sum(n), 0)::hugeint + 2 * any_value(v) as total
    from grp g join v using (lang) left join counts using (lang, source) group by g.lang, g.source),
whole as (select lang, sum(total - 2 * v)::hugeint + 2 * any_value(v) as total from total join v using (lang) group by lang),
share as (
    select k.lang, t.source, k.term, coalesce(n, 0) as n, 1 + 1000000000 * (coalesce(n, 0) + 2) // total as p
    from kept k join total t using (lang) left join counts c on c.lang = k.lang and c.term = k.term and c.source = t.source),
all_share as (
    select lang, term, 1 + 1000000000 * (sum(n)::hugeint + 2) // any_value(w.total) as q
    from counts join whole w using (lang) group by lang, term),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join share x on x.lang = a.lang and x.source = a.source
    left join share y on y.lang = a.lang and y.source = b.source and y.term = x.term
    group by a.lang, a.source, b.source),
terms as (
    select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
    from share join all_share using (lang, term) where n > 0 and p > q),
found as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms),
ranked as (
    select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_decontaminate,
        op3_token_files,
        op4_quality_classifier,
        op5_repeated_paragraphs,
        op6_repeated_bytes,
        op7_quality_rules,
        op8_near_duplicates,
        op9_secret_scan,
        op10_token_counts,
        op11_sentencepiece,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}
ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_decontaminate": OP2_SQL, "op12_source_divergence": OP12_SQL}
