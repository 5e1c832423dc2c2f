"""The thin queries over the test tables: one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, mixture, neighbours, ngram_model, repeats, secrets, simhash, spotsigs, token_counts, training_order, vector_codes
from .shared import crc_remainder, documents

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Tokenizer and end token of the written sequences.
SEQUENCE_TOKENIZER, END_TOKEN = "piece_bpe_32k.model", 2


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(documents(spark, sf_dir), length=400, scan=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), token_counts.new_cache(spark))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture.plan_mixture(documents(spark, sf_dir), weights=(5, 2, 1), most=3.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select source, source_size, 3.0::double * source_size as cap,
         ([5.0::double, 2.0::double, 1.0::double])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sources),
levels as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over before, 0))
            / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from weighted
  window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, least(cap, weight * max(level) over ()) as target from levels),
placed as (
  select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from sized),
joined as (
  select doc_id, size, source_size, target, start, cast(floor(target) as bigint) as budget,
         cast(floor(target) as bigint) // greatest(source_size, 1) as epochs
  from placed join targets on placed.source is not distinct from targets.source)
select doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(budget - epochs * source_size - start, size)) as bigint) as taken
from joined
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(documents(spark, sf_dir), radius=4, size=4)
    return linked.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(documents(spark, sf_dir), public_tokenizers.path(SEQUENCE_TOKENIZER), END_TOKEN)


def op8_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False)))
    return ngram_model.score(docs, scan=True)


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    remainder = crc_remainder("doc_id", 5)
    model = language.train(docs.where(F.coalesce(remainder, F.lit(-1)) != 0))
    said = language.identify(docs, model, keep=["doc_id"])
    return said.withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(embeddings(spark, sf_dir))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op11_sql() -> str:
    """The rounds as one query: parts as rows, each round's codebooks from the one before."""
    rounds = []
    for k in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""
near{k} as materialized (
  select vec_id, p.part, p.x, arg_min(b.entry, (list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.y)])::hugeint * 16 + b.entry)) as entry,
         (min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.y)])::hugeint * 16 + b.entry) // 16)::bigint as distance
  from pieces p join book{k} b on p.part = b.part group by all)""")
        if k < vector_codes.ROUNDS:
            rounds.append(f"""
book{k + 1} as materialized (
  select b.part, b.entry, coalesce(m.y, b.y) as y
  from book{k} b left join (
    select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as y
    from (select part, entry, place, sum(v)::hugeint as s, count(*)::hugeint as n
          from (select part, entry, unnest(x) as v, unnest(range(len(x))) as place from near{k}) group by all)
    group by all) m on b.part = m.part and b.entry = m.entry)""")
    last = vector_codes.ROUNDS
    return f"""
with kept as (
  select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
pieces as materialized (
  select vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] as x from kept, range(8) t(part)),
book0 as materialized (
  select part, entry, x as y from pieces join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept) using (vec_id) where entry < 16),
{",".join(rounds)},
coded as (
  select vec_id, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(distance)::bigint as error from near{last} group by vec_id),
named as (
  select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as codebooks_sha256 from book{last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), named
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


OP12_SQL = """
with kept as (
  select vec_id, [x::double for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x != 0]) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) as score
  from kept q join kept c on q.vec_id != c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 20
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP13_SQL = r"""
with pieces as materialized (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents)),
f1 as materialized (select lang, p, count(*)::hugeint as f from (select lang, unnest(w) as p from pieces) group by all),
f2 as materialized (
  select lang, x, y, count(*)::hugeint as f from (select lang, w[i] as x, w[i + 1] as y from (select lang, w, unnest(range(1, len(w))) as i from pieces)) group by all having count(*) >= 10),
f3 as materialized (
  select lang, x, y, z, count(*)::hugeint as f
  from (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z from (select lang, w, unnest(range(1, len(w) - 1)) as i from pieces)) group by all having count(*) >= 10),
longer as (select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by all),
two as (
  select f2.lang, f2.x || ' ' || f2.y as phrase, f2.f as a, l.f as l, r.f as r, 1000000 * f2.f * f2.f // (l.f * r.f) as score
  from f2 join f1 l on l.lang = f2.lang and l.p = f2.x join f1 r on r.lang = f2.lang and r.p = f2.y
  left join longer g on g.lang = f2.lang and g.x = f2.x and g.y = f2.y
  where g.f is null or 100 * g.f < 50 * f2.f),
cuts as (
  select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z as phrase, f3.f as a, 1 as k, l.f as l, r.f as r
  from f3 join f1 l on l.lang = f3.lang and l.p = f3.x join f2 r on r.lang = f3.lang and r.x = f3.y and r.y = f3.z
  union all
  select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, l.f, r.f
  from f3 join f2 l on l.lang = f3.lang and l.x = f3.x and l.y = f3.y join f1 r on r.lang = f3.lang and r.p = f3.z),
three as (
  select lang, phrase, a, l, r, 1000000 * a * a // (l * r) as score
  from cuts qualify row_number() over (partition by lang, phrase order by 1000000 * a * a // (l * r), k) = 1),
sizes as (select lang, sum(f)::bigint as n from f1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (from two union all from three) join sizes using (lang) qualify rank <= 2000
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_strings, op2_token_counts, op3_benchmark_leaks, op4_source_mixture, op5_secret_scan,
        op6_simhash_groups, op7_training_order, op8_model_scores, op9_spot_signatures, op10_language,
        op11_vector_codes, op12_nearest_neighbours, op13_collocations,
    )
}
ORACLE_SQL = {"op4_source_mixture": OP4_SQL, "op11_vector_codes": _op11_sql(), "op12_nearest_neighbours": OP12_SQL, "op13_collocations": OP13_SQL}
