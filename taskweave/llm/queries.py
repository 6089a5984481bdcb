"""One query per operator, over its whole table; the digests come from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.llm import bitslice, bpe, hardneg, langid, lexical, minhash, mixing, nndescent, pii, quality, subspace, substring, warc
from taskweave.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op6_bpe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op9_mixing",
    # Levels of the schedule: two, the second for sources whose target spans less than 64 slots of the first.
    """with d as (select doc_id, source, md5('mix:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))) as key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
by_source as (select source, sum(size)::bigint as source_size from d group by source),
placed as (select *, row_number() over (order by source asc nulls last) - 1 as place from by_source),
weighted as (select *, [5, 2, 1][(place % 3 + 1)::int]::bigint as weight, source_size * 3 as ceiling from placed),
open as (select *, sum(source_size) over () - coalesce(sum(ceiling) over (order by ceiling / weight, place rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over () - coalesce(sum(weight) over (order by ceiling / weight, place rows between unbounded preceding and 1 preceding), 0) as still from weighted),
first_open as (select rest as level_rest, still as level_still from open where ceiling * still > rest * weight order by ceiling / weight, place limit 1),
targeted as (select source, place, source_size, case when ceiling * still <= rest * weight then ceiling::double else level_rest::double * weight / level_still end as target from open left join first_open on true),
l0 as (select count(*) as n, sum(target) as whole, (select sum(source_size) from by_source)::bigint as words, greatest(65536, pow(2, ceil(log2(128 * count(*)))))::bigint as slots from targeted where target > 0),
t0 as (select t.*, slots, words, whole, target * slots < 64 * whole as small from targeted t, l0 where target > 0),
e0 as (select place, slots, words, least(ceil(sum(target) over (order by place) * slots / whole - 1e-6)::bigint, slots - (select count(*) > 0 from t0 where small)::int) as upper from t0 where not small),
r0 as (select place, slots, words, coalesce(lag(upper) over (order by place), 0) as lower, upper from e0 union all select -1, any_value(slots), any_value(words), (select max(upper) from e0), any_value(slots) from t0 where small having count(*) > 0),
l1 as (select sum(target) as whole, greatest(1, round(sum(target)))::bigint as words, greatest(65536, pow(2, ceil(log2(128 * count(*)))))::bigint as slots from t0 where small),
e1 as (select place, l1.slots, l1.words, ceil(sum(target) over (order by place) * l1.slots / l1.whole - 1e-6)::bigint as upper from t0, l1 where small),
r1 as (select place, slots, words, coalesce(lag(upper) over (order by place), 0) as lower, upper from e1),
reach as (select place, slots, words, (upper - lower) * words // slots as reach from (from r0 where place >= 0 union all from r1)),
steps as (select slots, (floor(slots * (sqrt(5) - 1) / 4) * 2 + 1)::bigint as step from (select slots from l0 union select slots from l1 where slots is not null)),
points as (select slots, unnest(range(slots)) as slot, step from steps),
s0 as (select r0.place, row_number() over (partition by r0.place order by slot) - 1 as rank, slot from points join r0 on points.slots = r0.slots and (slot * step) % points.slots >= lower and (slot * step) % points.slots < upper),
s1 as (select r1.place, r1.slots, row_number() over (partition by r1.place order by slot) - 1 as rank, slot from points join r1 on points.slots = r1.slots and (slot * step) % points.slots >= lower and (slot * step) % points.slots < upper),
schedule as (select place, rank, slot::varchar as path from s0 where place >= 0
  union all select s1.place, s1.rank, s0.slot || '.' || s1.slot from s1 join s0 on s0.place = -1 and s0.rank = s1.slot * (select count(*) from s0 where place = -1) // s1.slots),
lines as (select d.*, t.place, source_size, target, slots, words, coalesce(reach, 0) as reach, coalesce(sum(size) over (partition by t.place order by key, d.doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join targeted t on d.source is not distinct from t.source left join reach using (place))
select lines.doc_id, lines.size, source_size, target, (greatest(least(start + size, reach) - start, 0) + greatest(least(start + source_size + size, reach) - start - source_size, 0) + greatest(least(start + 2 * source_size + size, reach) - start - 2 * source_size, 0))::bigint as taken, path as first_slot
from lines left join schedule on schedule.place = lines.place and size > 0 and start < reach and schedule.rank = ((start + 1) * slots - 1) // words""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    path = F.array_join(F.transform("first_slot", lambda s: s.cast("string")), ".")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", path.alias("first_slot"))


@query(
    "op8_warc",
    """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
firsts as (select hex, min(page_id) as first from p group by hex)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * i)::int, 5))::bigint >> s) & 31)::int, 1)), '')), '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from p join firsts using (hex)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op4_bitslice",
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(rows, rows.where("vec_id % 50 = 0"))


# No oracle: the search is approximate. Its recall is measured against brute force in the tests.
@query("op2_nndescent")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nndescent.nearest(rows, rows.where("vec_id % 50 = 0"))


@query("op7_langid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.learn(docs, ~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), langid.language_of(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


@query("op10_quality")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), quality.score_of(F.col("text"), model, [F.col("n_chars")]).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query(
    "op5_minhash",
    """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
sets as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as s from w),
sized as (select doc_id, s, len(s)::bigint as n from sets),
classes as (select min(doc_id) as node, list_sort(s) as s, any_value(n) as n from sized where n > 0 group by list_sort(s)),
tokens as (select node, n, unnest(s) as t from classes),
common as (select a.node as x, b.node as y, a.n as xn, b.n as yn, count(*) as inter from tokens a join tokens b on a.t = b.t and a.node < b.node and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all),
links as (select x, y from common where 100 * inter >= 75 * (xn + yn - inter)),
edges as (select x, y from links union select y, x from links),
r(node, other) as (select x, y from edges union select r.node, edges.y from r join edges on r.other = edges.x),
reach as (select node, min(other) as low from r group by node),
named as (select c.node, list_sort(c.s) as s, least(c.node, coalesce(low, c.node)) as component from classes c left join reach using (node))
select doc_id, sized.n as n_shingles, coalesce(component, doc_id) as component_id, doc_id = coalesce(component, doc_id) as kept from sized left join named on list_sort(sized.s) = named.s and sized.n > 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op3_substring",
    """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
windows as (select doc_id, unnest(range(1, len(words) - 48)) as s, unnest(list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' ')))) as h from w where len(words) >= 50),
firsts as (select h, min(doc_id) as first from windows group by h),
hits as (select distinct doc_id, unnest(range(s, s + 50)) as i from windows join firsts using (h) where first < doc_id),
gone as (select doc_id, list(i) as gone from hits group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when gone is null then array_to_string(words, ' ') else coalesce(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda p: not list_contains(gone, p[2])), lambda p: p[1]), ' '), '') end) as kept_sha256
from w left join gone using (doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


# No oracle: the added spans are learned. The base spans are tested against plain regular expressions.
@query("op1_pii")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    counts = [pii.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query(
    "op11_lexical",
    """with words as (select doc_id, row_number() over () as row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents),
counted as (select row, doc_id, term, count(*) as tf from words group by all),
sized as (select row, sum(tf)::bigint as n from counted group by row),
total as (select count(*)::bigint as docs, sum(n)::bigint as all_terms from sized),
item_terms as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where item_id is not null),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counted, total group by term, docs),
parts as (select row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // all_terms))) as part from counted join sized using (row) join weights using (term), total),
scored as (select item_id, row, doc_id, sum(part)::bigint as score from item_terms join parts using (term) group by all having sum(part) > 0),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored)
select * from ranked where rank <= 10""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_hardneg",
    """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
negatives as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score from positives join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank, negative_id, positive_score, negative_score from negatives
qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 10""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine(rows, rows.where("vec_id % 100 = 0"))


@query(
    "op13_subspace",
    """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as u from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.u, b.u) >= 0.93),
r(node, other) as (select x, y from edges union select r.node, edges.y from r join edges on r.other = edges.x),
reach as (select node, min(other) as low from r group by node),
counted as (select x, count(*) as n from edges group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join counted on vec_id = x left join reach on vec_id = node""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))
