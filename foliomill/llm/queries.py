"""The queries ``opN_<name>`` and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import DigestIndex

    index = DigestIndex(spark, f"foliomill_digests_{uuid.uuid4().hex}")
    out = index.add(documents(spark, sf_dir))
    spark.sql(f"drop table {index.table}")  # of this call alone; the result does not read it
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import rates

    out = rates(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Water-filling in closed form: sources in the order in which they reach their cap.
OP10_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint >> 28 as coin from documents),
s as (select source, sum(size)::bigint as n from d group by source),
w as (select source, n, 3.0::double * n as most, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight from s),
h as (select *, (sum(n) over ())::double as total, most / weight as cap,
             coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as held,
             sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as open_weight from w),
l as (select coalesce(arg_min((total - held) / open_weight, held) filter ((total - held) / open_weight <= cap), 0) as level from h),
t as (select source, n, least(weight * level, most) as target from w, l),
b as (select *, case when n > 0 then floor(least(target / n, 3.0::double)) else 0 end as base from t),
e as (select d.source, coin + 1 as cut, sum(sum(size)) over (partition by d.source order by coin) as upto from d group by d.source, coin
      union all select source, 0, 0 from s),
c as (select b.source, arg_min(e.cut, (abs(e.upto - (b.target - b.base * b.n)), e.cut)) as cut
      from b join e on b.source is not distinct from e.source group by b.source)
select doc_id, size, b.n as source_size, b.target, (size * (b.base + case when coin < c.cut then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source join c on d.source is not distinct from c.source
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, tokenize

    docs = documents(spark, sf_dir).select("doc_id", "text")
    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return pack(tokenize(docs, *paths, keep_ids=False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import LanguageModel, held_out

    docs = documents(spark, sf_dir)
    model = LanguageModel.fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = model.predict(docs.select("doc_id", "text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
with d as (select doc_id, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as x, len(ls) as n from d where ls is not null),
w as (select *, lead(x) over (partition by doc_id order by pos) as y from l),
s as (select doc_id, pos, row_number() over (partition by x, y order by doc_id, pos) as nth from w
      where pos < n and regexp_matches(x || chr(10) || y, '[^\x20\x09-\x0D]')),
c as (select doc_id, pos from s where nth > 1 union select doc_id, pos + 1 from s where nth > 1),
k as (select l.doc_id, count(*) as n_lines, count(c.pos) as n_removed,
             coalesce(string_agg(x, chr(10) order by l.pos) filter (c.pos is null), '') as kept
      from l left join c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                          else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as gs from w),
e as (select doc_id, unnest(gs) as x from g),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
k as (select u, v from p join g a on u = a.doc_id join g b on v = b.doc_id where 100 * c >= 80 * (len(a.gs) + len(b.gs) - c)),
sym as (select u, v from k union all select v, u from k),
reach(node, other) as (select u, v from sym union select r.node, b.v from reach r join sym b on r.other = b.u),
least_of as (select node, min(other) as other from reach group by node)
select doc_id, len(gs)::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id from g left join least_of on doc_id = node
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as word, len(ws) as n, ws from d),
k as (select doc_id, pos, word, case when pos + 49 <= n then sha256(array_to_string(ws[pos:pos + 49], ' ')) end as x from w),
f as (select *, x is not null and min(doc_id) over (partition by x) < doc_id as again from k),
c as (select doc_id, pos, word, max(again::int) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone from f),
r as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by pos) filter (gone = 0) as kept from c group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r on d.doc_id = r.doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_suffixes

    out = dedup_suffixes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("digest")).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import select_quality

    out = select_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "log_weight", "sampling_key", F.col("place").alias("draw"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x : floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .scratch import folder, only
    from .token_store import read_tokens, write_tokens

    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]

    def written_and_read() -> DataFrame:
        store = folder(spark, "token-store")
        write_tokens(documents(spark, sf_dir), store, *paths)
        return read_tokens(spark, store, keep_ids=False)

    return only(written_and_read, "token-ids")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
o as (select r, lang, source, unnest(ts) as term from d),
t as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= 3),
c as (select o.lang, o.source, o.term, count(*) as n from o join t on o.lang = t.lang and o.term = t.term group by all),
l as (select lang, count(*) as v, sum(n) as words from t group by lang),
g as (select lang, source, coalesce(sum(n), 0) as size from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
p as (select g.lang, g.source, t.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.size + l.v)::hugeint as p,
             1 + (1000000000::hugeint * (t.n + 1)) // (l.words + l.v)::hugeint as q
      from g join t on g.lang = t.lang join l on g.lang = l.lang left join c on c.lang = g.lang and c.source = g.source and c.term = t.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from every
           union all select *, 'term', row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x : floor(256 * x::double)) as v
           from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as own, list_dot_product(a.v, c.v)::bigint as score
      from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where own
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id and not own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


QUERIES = {"op7_exact_dedup": op7_exact_dedup, "op10_mixing": op10_mixing, "op5_packing": op5_packing, "op9_language_id": op9_language_id, "op8_line_dedup": op8_line_dedup, "op6_jaccard_join": op6_jaccard_join, "op1_substring_dedup": op1_substring_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op2_quality": op2_quality, "op4_topk_search": op4_topk_search,
    "op11_hard_negatives": op11_hard_negatives, "op12_token_ids": op12_token_ids, "op13_source_divergence": op13_source_divergence}
SQL = {"op1_substring_dedup": OP1_SQL, "op4_topk_search": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_mixing": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
