"""DuckDB SQL of those operators' queries that SQL can express."""

from __future__ import annotations

#: Vectors that take part, as whole numbers.
_KEPT = """kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""


def _nearest(name: str, books: str) -> str:
    """Each part's least (distance, entry)."""
    return f"""{name} as (
  select vec_id, p, min(row(d, e)) as best
  from (select a.vec_id, a.p, b.e, sum((a.x - b.x) * (a.x - b.x)) as d from parts a join {books} b on a.p = b.p and a.k = b.k group by 1, 2, 3)
  group by 1, 2
)"""


def _moved(name: str, books: str, near: str) -> str:
    """Entries become the floors of their parts' means; those without parts stay."""
    return f"""{name} as (
  select b.p, b.e, b.k, coalesce(m.x, b.x) as x
  from {books} b left join (
    select p, e, k, (s - ((s % n) + n) % n) // n as x
    from (select a.p, c.best[2] as e, a.k, cast(sum(a.x) as bigint) as s, count(*) as n from parts a join {near} c on a.vec_id = c.vec_id and a.p = c.p group by 1, 2, 3)
  ) m on b.p = m.p and b.e = m.e and b.k = m.k
)"""


OP11 = f"""with {_KEPT},
parts as (
  select vec_id, cast((i - 1) // (len(v) // 16) as int) as p, cast((i - 1) % (len(v) // 16) as int) as k, v[i] as x
  from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from kept)
),
books0 as (
  select p, dense_rank() over (order by vec_id) - 1 as e, k, x from parts
  where vec_id in (select vec_id from kept order by vec_id limit 64)
),
{_nearest("near0", "books0")}, {_moved("books1", "books0", "near0")},
{_nearest("near1", "books1")}, {_moved("books2", "books1", "near1")},
{_nearest("near2", "books2")},
coded as (
  select vec_id, string_agg(lower(printf('%02x', best[2])), '' order by p) as code, cast(sum(best[1]) as bigint) as error from near2 group by 1
)
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by p, e, k)) from books2) as codebooks_sha256
from coded c join kept k on c.vec_id = k.vec_id"""

OP12 = """with page as (
  select page_id, coalesce(html, '') as payload from pages
), digests as (
  select page_id, strlen(payload) as payload_bytes, sha1(payload) as h, max(page_id) over (partition by payload) as largest from page
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as int), 1)), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from largest then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from largest then largest end as refers_to
from digests"""

OP13 = f"""with {_KEPT},
turned as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from kept where label is not null
),
anchors as (select * from turned where vec_id % 50 = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as score
  from anchors a join turned b on a.vec_id <> b.vec_id
),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) as int) as rank,
  n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) <= 3"""

ORACLE = {"op11_vector_codes": OP11, "op12_warc": OP12, "op13_hard_negatives": OP13}
