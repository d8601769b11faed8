"""The queries opN_<name> of this package's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe, conversation, exact_dedup, fingerprint, html_extract, importance, lm_score, mixing, rollup, sharding, simhash, toxicity, vector_search
from noticelake.llm._shared import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with texts as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from texts window same as (partition by norm)
"""


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive under one tokenizer version and those in English are revised to the next, in a batch that is sent twice; those
    of under 100 characters are deleted and come back.  A document is its id, source and language, in which all its rows agree."""
    docs = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "source", "lang")).alias("doc_id"), "text", "source", "lang")
    short = docs.filter("length(coalesce(text, '')) < 100")
    store = rollup.RollupStore(spark)
    store.apply("arrive", rollup.counts(docs, "words-1"))
    for _ in range(2):
        store.apply("revise", rollup.counts(docs.filter("lang = 'en'"), "words-2", "revise"))
    store.apply("delete", rollup.counts(short, "words-1", "delete"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    counted = rollup.counts(docs.filter(english), "words-2").union(rollup.counts(docs.filter(~english), "words-1"))  # counts move, not texts
    store.apply("return", counted.join(short.select(F.col("doc_id").alias("gone")).distinct(), F.col("doc_id") == F.col("gone"), "left_semi"))
    return store.totals()


OP8_SQL = r"""
with counted as (
    select source, lang, case when lang = 'en' then 'words-2' else 'words-1' end as tokenizer,
           len(regexp_extract_all(coalesce(text, ''), case when lang = 'en' then '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]' else '[^\x20\x09-\x0D]+' end)) as tokens
    from documents)
select source, lang, tokenizer, count(*) as docs, cast(sum(tokens) as bigint) as tokens
from counted group by source, lang, tokenizer
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    found = toxicity.scores(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def _bytes_sql(text: str) -> str:
    """The UTF-8 bytes of a text as a list, in DuckDB."""
    return f"""flatten(list_transform(string_split({text}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)]
        when unicode(ch) < 2048 then [192 + unicode(ch) // 64, 128 + unicode(ch) % 64]
        when unicode(ch) < 65536 then [224 + unicode(ch) // 4096, 128 + unicode(ch) // 64 % 64, 128 + unicode(ch) % 64]
        else [240 + unicode(ch) // 262144, 128 + unicode(ch) // 4096 % 64, 128 + unicode(ch) // 64 % 64, 128 + unicode(ch) % 64] end))"""


def _crc32_sql(text: str) -> str:
    """crc32 of a text that is not empty, in DuckDB, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, {_bytes_sql(text)}),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


def op11_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(rows, rows.filter("vec_id % 50 = 0"))


OP11_SQL = """
with points as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from points q join points c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation.Repair(conversation.damage(rows), texts=False).results()
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _edit(state: str, cost: str, initial: str, line: str, where: str = "true") -> str:
    return f"case when {state} is not null and {where} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 't': {state}.t || {line}}} end"


_LINE = "chr(10) || role || ':' || text"
_AS_USER, _AS_ASSISTANT = "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
_INSERT_USER, _INSERT_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_LIVE = "kind not in (1, 2)"
_WAY = "struct(c bigint, a varchar, t varchar)"
# the best way to each state before a row, closed under insertions
_CLOSED = f"""(select *, least(s3, {_edit('i2', '5', 'I', _INSERT_ASSISTANT)}) as i3
    from (select *, least(s2, {_edit('s0', '5', 'I', _INSERT_USER)}, {_edit('s1', '5', 'I', _INSERT_USER)}, {_edit('s3', '5', 'I', _INSERT_USER)}) as i2 from SOURCE))"""
_OP12_STEP = _CLOSED.replace("SOURCE", "(select ways.*, r.role, r.text, r.kind, r.more from ways join faults r on r.conv = ways.conv and r.pos = ways.pos + 1)")
OP12_SQL = rf"""
with recursive filled as (
    select coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
damaged as (
    select conv, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy from filled where kind <> 0),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as pos from damaged),
faults as (
    select *, case kind when 3 then 5 else 0 end as more from (
        select conv, pos, turn, role, text, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
            when row_number() over (partition by conv, role, text order by pos) > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as kind from placed)),
ways as (
    select distinct conv, 0::bigint as pos, {{'c': 0::bigint, 'a': '', 't': ''}}::{_WAY} as s0, null::{_WAY} as s1, null::{_WAY} as s2, null::{_WAY} as s3 from faults
    union all
    select conv, pos + 1, {_edit('s0', '2', 'D', "''")},
        least({_edit('s1', '2', 'D', "''")}, {_edit('s0', 'more', 'K', _LINE, f"{_LIVE} and left(role, 1) = 's'")}),
        least({_edit('i2', '2', 'D', "''")}, {", ".join(_edit(s, 'more', 'K', _LINE, f"{_LIVE} and left(role, 1) = 'u'") + ", " + _edit(s, '1 + more', 'R', _AS_USER, _LIVE) for s in ('s0', 's1', 'i3'))}),
        least({_edit('i3', '2', 'D', "''")}, {_edit('i2', 'more', 'K', _LINE, f"{_LIVE} and left(role, 1) = 'a'")}, {_edit('i2', '1 + more', 'R', _AS_ASSISTANT, _LIVE)})
    from {_OP12_STEP}),
ends as (select conv, least(s0, i3) as way from {_CLOSED.replace("SOURCE", "(select * from ways where (conv, pos) in (select conv, max(pos) from faults group by conv))")}),
pairs as (select *, lag(initial) over (partition by conv order by pos) || initial as pair from faults),
counts as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where kind = 1) as blank, count(*) filter (where kind = 2) as duplicate,
        count(*) filter (where kind = 3) as truncated, count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal from pairs group by conv)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(way.c, 0) as cost, coalesce(way.a, '') as audit, sha256(coalesce(substr(way.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join ends on ends.conv = coalesce(c.conv_id::varchar, ' ') left join counts on counts.conv = coalesce(c.conv_id::varchar, ' ')
"""


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_OP13_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
with words as (
    select true as corpus, doc_id as id, {_OP13_WORDS} as w from documents union all select false, item_id, {_OP13_WORDS} from benchmark),
counted as (
    select corpus, id, gram, count(*) as n
    from (select corpus, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from words) group by all),
hashed as (select gram, {_crc32_sql("gram")} % 10000 as bucket from (select distinct gram from counted)),
sums as (
    select r.bucket, coalesce(sum(n) filter (where corpus), 0) as s, coalesce(sum(n) filter (where not corpus), 0) as t
    from range(10000) r(bucket) left join (select * from counted join hashed using (gram)) c on c.bucket = r.bucket group by r.bucket),
gains as (
    select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from sums),
weighed as (
    select id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight
    from counted join hashed using (gram) join gains using (bucket) where corpus group by id),
scored as (
    select d.id as doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from words d left join weighed using (id) where d.corpus),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () * 25 // 100 as drawn from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from scored left join ranked using (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_improbable_features, op2_exact_dedup, op3_host_suffix_array, op4_vector_packing, op5_ppm_score, op6_simhash, op7_temperature_mix, op8_token_rollup, op9_toxicity, op10_byte_bpe, op11_mtree_search, op12_conversation_repair, op13_importance_resample)}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op8_token_rollup": OP8_SQL, "op11_mtree_search": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance_resample": OP13_SQL}
